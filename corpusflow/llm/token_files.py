"""Token ids as Parquet lists: dictionary-coded ids, delta-coded keys, bounded row groups, page indexes, selective reads.

A token store is a folder: ``data`` holds one file per range of document ids, in ascending order, and ``offsets`` one row
per file with the number of tokens before it.  Places inside a file count from its first token, so no file is written twice.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from string import ascii_lowercase
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.order import bases, in_order
from corpusflow.llm.tables import broadcast_if_small, kept_by_worker
from corpusflow.llm.texts import SPECIAL, Remembered, slices, strings

FILE_BYTES = 32_000_000  # of text that one file takes, about
ROW_GROUP_BYTES = 8_000_000
PAGE_BYTES = 65_536
PAGE_ROWS = 1_000
# Pieces of text whose ids a worker remembers; beyond it the longest unused go.
REMEMBERED = 400_000
# Text whose distinct pieces are looked up together, and words that go to the library at once.
SLICE_BYTES = 4_000_000
_WORDS = 1_000
_LETTERS = ascii_lowercase + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_SIGNS = b"!\"#%&'()*+,-./:;=?"


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, as 32-bit integers.

    Only for tokenizers whose tokens, special tokens and normalisation never go across ASCII white space, which is dropped:
    then the ids of a text are those of the pieces between white space, one after another, and each piece is encoded once.
    Words of Latin letters, and the signs behind them, are told apart, looked up and put together by Arrow; new ones go to the
    library's model many at a time; what ends a word tells their ids apart.  Other pieces are encoded by its normaliser,
    splitter and model one by one, which saves building their offsets.
    """

    def __init__(self, definition: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.normal, self.split = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        # whether small letters are words as the splitter spells them one by one, and punctuation behind them is apart
        alone = lambda text: [word for word, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]
        self.spelt = str.maketrans({c: "".join(alone(c)) for c in _LETTERS})
        self.plain = all(alone(_LETTERS + sign) == [_LETTERS.translate(self.spelt), sign] for sign in _SIGNS.decode())
        self.together = Tokenizer(self.model)
        self.together.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = self.together.get_vocab(), json.loads(definition)["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.seen, self.seen_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.words = Remembered(self._word, REMEMBERED)
        self.known = Remembered(self._piece, REMEMBERED)

    def _word(self, word: str) -> bytes:
        return array("i", [token.id for token in self.model.tokenize(word)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        core, text = piece.rstrip(_SIGNS), piece.decode()
        if self.plain and not text.strip(_LETTERS):
            return self._word(text.translate(self.spelt))
        if self.plain and len(core) < len(piece) and (core[-1:].isalpha() or core and not core.decode().strip(_LETTERS)):
            return self.known[core] + self.known[piece[len(core) :]]
        if "<" in text:  # special tokens are found by the library alone
            return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self.words[word] for word, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))])

    def _spelt(self, words: list[str]) -> list[pa.Array]:
        """Ids of words of Latin letters, as bytes, from few calls of the library."""
        out = []
        for a in range(0, len(words), _WORDS):
            part = words[a : a + _WORDS]
            spelt = " ".join(part).translate(self.spelt)
            ids = np.array(self.together.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<i4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                at = np.concatenate([[0], 4 * ends])
                out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(ids)]))
            else:
                out.append(pa.array([self._word(word.translate(self.spelt)) for word in part], pa.large_binary()))
        return out

    def _letters(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words of Latin letters, which are remembered side by side in two arrays."""
        at = pc.index_in(words, value_set=self.seen)
        new = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = len(self.seen) + np.arange(len(new))
        self.seen = pa.concat_arrays([self.seen, new])
        self.seen_ids = pa.concat_arrays([self.seen_ids, *self._spelt(new.to_pylist())])
        ids = self.seen_ids.take(pa.array(at))
        if len(self.seen) > REMEMBERED:  # the last ones stay
            self.seen, self.seen_ids = words[:REMEMBERED], ids[:REMEMBERED]
        return ids

    def _ids(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of distinct pieces, as bytes, in an order of their own, and the place there of each piece."""
        core = pc.ascii_rtrim(pieces, characters=_SIGNS.decode())
        letters = pc.match_substring_regex(core, f"^[{_LETTERS}]+$") if self.plain else pa.array(np.zeros(len(pieces), bool))
        words = core.filter(letters).dictionary_encode()
        signs = pc.utf8_ltrim(pieces.filter(letters), characters=_LETTERS).dictionary_encode()
        after = pa.array([self.known[sign.encode()] if sign else b"" for sign in signs.dictionary.to_pylist()], pa.large_binary())
        ids = pc.binary_join_element_wise(self._letters(words.dictionary).take(words.indices), after.take(signs.indices), pa.scalar(b"", pa.large_binary()))
        others = pieces.filter(pc.invert(letters)).cast(pa.large_binary()).to_pylist()
        ids = pa.concat_arrays([ids, pa.array([self.known[piece] for piece in others], pa.large_binary())])
        self.known.trim()
        self.words.trim()
        first = letters.to_numpy(zero_copy_only=False)
        place = np.empty(len(pieces), np.int32)
        place[first], place[~first] = np.arange(len(words)), np.arange(len(words), len(pieces))
        return ids, place

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has; null texts are empty."""
        raw, offsets = strings(column)
        # an array that starts at its buffers' start: Arrow's ascii_lower takes others' first bytes for those of a slice
        texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(raw))
        # A-Z as a-z unless a special token's string could be meant
        texts = pc.if_else(pc.match_substring(texts, SPECIAL.decode()), texts, pc.ascii_lower(texts))
        pieces = pc.ascii_split_whitespace(texts)
        found = pieces.flatten().dictionary_encode()
        ids, place = self._ids(found.dictionary)
        _, ends, flat = ids.take(pa.array(place[found.indices.to_numpy()])).buffers()
        before = np.frombuffer(ends, np.int64, len(found) + 1) // 4
        flat = np.frombuffer(flat, "<i4", before[-1]) if before[-1] else np.zeros(0, "<i4")
        return flat, np.diff(before[pieces.offsets.to_numpy()])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        flat, sizes = self.encode_column(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        return [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", meta: Sequence[str] = (),
    file_bytes: int = FILE_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> None:
    """Write the ids of all whole texts, each followed by ``end``, in ascending order of ``key`` to the new folder ``path``.

    ``tokenizer`` is a tokenizer file's text.  ``meta`` names columns that are kept beside the ids, under any names.  Null and
    empty texts have ``end`` alone.  Rows without a key come first; rows of one key stand side by side, and each counts.
    """
    spark = docs.sparkSession
    held = docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *([F.struct(*[f"`{m}`" for m in meta]).alias("meta")] if meta else [])
    )
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(-(-size // file_bytes), min(spark.sparkContext.defaultParallelism, -(-size // 1_000_000)), 1)
    rows = in_order(held, ["doc_id", F.xxhash64("text")], tasks)
    shared, digest = spark.sparkContext.broadcast(tokenizer), sha256(tokenizer.encode()).hexdigest()
    fields = [held.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    fields += [held.schema["meta"]] if meta else []

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=SLICE_BYTES, keeps=("pieces",)):
            ids, sizes = kept_by_worker("pieces", digest, lambda: PieceEncoder(shared.value)).encode_column(batch.column("text"))
            flat = np.insert(ids, np.cumsum(sizes), end)
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            columns = [
                batch.column("doc_id"),
                pa.array(np.full(len(sizes), part, np.int32)),
                pa.array(at + ends - sizes),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                *([batch.column("meta")] if meta else []),
            ]
            at += int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",  # numbers without a dictionary are then delta-coded
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": "true",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
    }
    rows.mapInArrow(encode, T.StructType(fields)).write.options(**options).parquet(f"{path}/data")
    counts = read_data(spark, path).select("part", "n_tokens")
    bases(counts, F.col("n_tokens")).write.parquet(f"{path}/offsets")


def read_data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "start", "n_tokens", "tokens"), low: Any = None, high: Any = None) -> DataFrame:
    """Documents with their first token's place ``start`` in the whole store; only the named columns are read.

    ``columns`` may also name ``meta``.  ``low`` and ``high`` bound the document ids, both inclusive, by statistics of files,
    row groups and pages.
    """
    data, wanted = read_data(spark, path), [c for c in columns if c != "start"]
    if low is not None:
        data = data.where(F.col("doc_id") >= F.lit(low))
    if high is not None:
        data = data.where(F.col("doc_id") <= F.lit(high))
    if "start" not in columns:
        return data.select(*columns)
    offsets = broadcast_if_small(spark.read.parquet(f"{path}/offsets").select("part", "base"))
    return data.select(*wanted, "part", "at").join(offsets, "part").withColumn("start", F.col("base") + F.col("at")).select(*columns)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(doc_id, start, tokens) of what documents have at the places ``first`` to ``last - 1`` of the whole store.

    The offsets say which files can hold them; in those, pages are chosen by the places of documents.
    """
    offsets = spark.read.parquet(f"{path}/offsets")
    files = offsets.where((F.col("base") < last) & (F.col("base") + F.col("total") > first))
    ends = files.agg(F.min("part"), F.max("part"), F.min("base"), F.max("base")).first()
    data = read_data(spark, path)
    if ends[0] is None or last <= first:
        return data.select("doc_id", F.col("at").alias("start"), "tokens").limit(0)
    data = data.where(F.col("part").between(ends[0], ends[1]))
    data = data.where((F.col("part") < ends[1]) | (F.col("at") < last - ends[3]))
    data = data.where((F.col("part") > ends[0]) | (F.col("at") + F.col("n_tokens") > first - ends[2]))
    rows = data.select("doc_id", "part", "at", "n_tokens", "tokens").join(broadcast_if_small(files.select("part", "base")), "part")
    start = F.col("base") + F.col("at")
    low, high = F.greatest(start, F.lit(first)), F.least(start + F.col("n_tokens"), F.lit(last))
    piece = F.slice("tokens", (low - start + 1).cast("int"), (high - low).cast("int"))
    return rows.where(high > low).select("doc_id", low.alias("start"), piece.alias("tokens"))
