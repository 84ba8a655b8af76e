"""Benchmark passages in documents by winnowing: the minimum hash of every window, a join of fingerprints, extended hits."""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import annotate, original
from corpusflow.llm.texts import ALNUM, LOWER, grams, span_hashes, strings, word_spans

SPAN = 13
GRAM = 5
# UTF-8 bytes of items whose index goes to every task at once; a larger benchmark is taken in so many blocks.
BLOCK_BYTES = 16_000_000


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = strings(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets, ALNUM)
    return span_hashes(data, starts, ends), counts


def room(counts: np.ndarray) -> np.ndarray:
    """For every word, how many words its text has from there on."""
    return np.repeat(counts[1:], np.diff(counts)) - np.arange(counts[-1])


def winnowed(words: np.ndarray, counts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the rightmost smallest gram of every window of span - gram + 1 grams inside one text.

    What a window picks depends on its words alone, so two texts that share ``span`` words share a pick at the same
    place of the shared passage.
    """
    hashes, width = grams(words, gram), span - gram + 1
    size = len(hashes) - width + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, where = hashes[width - 1 :].copy(), np.full(size, width - 1, np.int64)
    for j in range(width - 2, -1, -1):
        less = hashes[j : j + size] < best
        best[less] = hashes[j : j + size][less]
        where[less] = j
    picked = np.unique((where + np.arange(size))[room(counts)[:size] >= span])
    return picked, hashes[picked]


def runs(positions: np.ndarray, hashes: np.ndarray, owners: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index, length and step of runs of equal hashes at equal steps of at most ``gram`` words inside one text.

    All words of a run's stretch are then known from its grams: a text that says the same over and over is few runs.
    """
    if not len(positions):
        return (np.zeros(0, np.int64),) * 3
    step = np.diff(positions)
    joins = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1]) & (step > 0) & (step <= gram)
    joins[1:] &= ~joins[:-1] | (step[1:] == step[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~joins]))
    length = np.diff(np.append(first, len(positions)))
    return first, length, np.where(length > 1, np.append(step, 0)[first], 0)


class ItemIndex:
    """Fingerprints of the items of at least ``span`` words, and whole hashes of the shorter ones."""

    def __init__(self, ids: list, texts: list, span: int, gram: int) -> None:
        self.ids, self.span, self.gram = ids, span, gram
        self.words, self.counts = hashed_words(pa.array(texts, pa.string()))
        positions, hashes = winnowed(self.words, self.counts, span, gram)
        order = np.argsort(hashes, kind="stable")  # by position among equal ones
        self.owner = np.repeat(np.arange(len(ids)), np.diff(self.counts))
        first, self.lengths, self.steps = runs(positions[order], hashes[order], self.owner[positions[order]], gram)
        self.hashes, self.positions = hashes[order][first], positions[order][first]
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, (a, b) in enumerate(zip(self.counts[:-1], self.counts[1:], strict=True)):
            if 0 < b - a < span:
                self.short[int(b - a)][int(grams(self.words[a:b], int(b - a))[0])].append(i)
        self.short = {n: dict(x) for n, x in self.short.items()}

    def hits(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, word behind the last) of all passages that hold a whole window of an item."""
        found: list[tuple[int, int, int]] = []
        space = room(counts)
        for n, wanted in self.short.items():
            hashes = grams(words, n)
            keys = np.fromiter(wanted, np.uint64, len(wanted))
            for p in np.flatnonzero(np.isin(hashes, keys) & (space[: len(hashes)] >= n)).tolist():
                found += [(item, p, p + n) for item in wanted[int(hashes[p])]]
        picked, hashes = winnowed(words, counts, self.span, self.gram)
        docs = np.searchsorted(counts, picked, "right") - 1
        first, lengths, steps = runs(picked, hashes, docs, self.gram)
        lo, hi = np.searchsorted(self.hashes, hashes[first], "left"), np.searchsorted(self.hashes, hashes[first], "right")
        known = hi > lo
        reached: dict[tuple[int, int], int] = {}  # per item and shift, the word behind the last passage
        columns = (picked[first], docs[first], lengths, steps, lo, hi)
        for p0, doc, n, step, a, b in zip(*[c[known].tolist() for c in columns], strict=True):
            begin, end = int(counts[doc]), int(counts[doc + 1])
            for r in range(a, b):
                q0, m, by = int(self.positions[r]), int(self.lengths[r]), int(self.steps[r])
                item = int(self.owner[q0])
                if n > 1 and m > 1 and step != by:
                    pairs = [(p0 + i * step, q0 + j * by) for i in range(n) for j in range(m)]
                else:  # one pair for each shift of the runs against each other
                    pairs = [(p0, q0 + j * by) for j in range(m - 1, 0, -1)] + [(p0 + i * step, q0) for i in range(n)]
                for p, q in pairs:
                    if reached.get((item, p - q), -1) > p:
                        continue
                    from_, last = self._extended(words, begin, end, item, p, q)
                    reached[item, p - q] = last
                    if last - from_ >= self.span:
                        found.append((item, from_, last))
        return found

    def _extended(self, words: np.ndarray, begin: int, end: int, item: int, p: int, q: int) -> tuple[int, int]:
        """The longest run of equal words through document word p and item word q."""
        item_begin, item_end = int(self.counts[item]), int(self.counts[item + 1])
        back, ahead = min(p - begin, q - item_begin), min(end - p, item_end - q)
        differs = np.flatnonzero(words[p - back : p][::-1] != self.words[q - back : q][::-1])
        first = p - (int(differs[0]) if len(differs) else back)
        differs = np.flatnonzero(words[p : p + ahead] != self.words[q : q + ahead])
        return first, p + (int(differs[0]) if len(differs) else ahead)


def _block_hits(docs: DataFrame, ids: list, texts: list, id_type: T.DataType, span: int, gram: int) -> DataFrame:
    # Of at most BLOCK_BYTES of text.  As bytes that hold the class too: workers need not be able to import it.
    index = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ItemIndex(ids, texts, span, gram)))
    opened: list[ItemIndex] = []
    arrow_id = pa.array(ids).type if ids else pa.int64()
    passage = pa.struct([("item_id", arrow_id), ("begin", pa.int64()), ("end", pa.int64())])

    def find(column: pa.Array) -> list[pa.Array]:
        if not opened:
            opened.append(pickle.loads(index.value))
        items = opened[0]
        words, counts = hashed_words(column)
        per_doc: list[list[dict]] = [[] for _ in range(len(column))]
        for item, first, last in items.hits(words, counts):
            doc = int(np.searchsorted(counts, first, "right")) - 1
            base = int(counts[doc])
            per_doc[doc].append({"item_id": items.ids[item], "begin": first - base, "end": last - base})
        return [pa.array(np.diff(counts), pa.int64()), pa.array(per_doc, pa.list_(passage))]

    kind = T.StructType([T.StructField("item_id", id_type), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return annotate(docs, "text", find, {"n_words": T.LongType(), "passages": T.ArrayType(kind)})


def passages(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` as :func:`annotate` gives them, with n_words and passages (item_id, begin, end in words).

    ``items``: (item_id, text).  Words are runs of ASCII letters and digits, lower-cased, and of non-ASCII characters.
    A passage holds ``span`` words or more in a row as an item has them, or a whole item of fewer words; null, empty and
    wordless items and texts have none.  Repeated items count once each under their id.  Items go to the tasks as an
    index in blocks of at most ``block_bytes`` of text; with several blocks the documents are read once for each and
    their passages put together by row, so the result is the same.
    """
    items = items.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    id_type = items.schema["item_id"].dataType

    def block(rows: DataFrame, i: int) -> DataFrame:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        got = part.toPandas()  # one block: bounded by block_bytes
        ids = [None if x is None or x != x else x for x in got["item_id"].astype(object)]
        return _block_hits(rows, ids, list(got["text"]), id_type, span, gram)

    if blocks == 1:
        return block(docs, 0)
    # the same row in several blocks: put together by its digest, then given back to every row
    digest = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    keyed = docs.select("text", digest.alias("_row"))
    parts = [block(keyed, i).select(F.col("c1").alias("_row"), "n_words", "passages") for i in range(blocks)]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    merged = union.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("passages"))).alias("passages")
    )
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], digest.alias("_row"))
    return rows.join(merged, "_row").drop("_row")


def n_hit(spans: Column) -> Column:
    """Number of words inside any of the passages: their union, by one fold over the sorted passages."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["begin"], acc["at"]), F.lit(0))).alias("n"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def contaminated(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """:func:`passages` with n_hit, item_ids (distinct, as sorted text) and contaminated: at least 5 % of the words are hit."""
    found = passages(docs, items, **options).withColumn("n_hit", n_hit(F.col("passages")))
    ids = F.array_sort(F.array_distinct(F.transform("passages", lambda s: F.coalesce(s["item_id"].cast("string"), F.lit("")))))
    rule = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return found.withColumn("item_ids", ids).withColumn("contaminated", rule)


def without_contaminated(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    return original(contaminated(docs, items, **options).where(~F.col("contaminated")), docs)
