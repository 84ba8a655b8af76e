"""Tokenisers as column expressions, vocabularies as tables, and id look-ups inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import kept_by_worker, written

SPACE = " \t\r\n\f"
UNK = "<unk>"

Tokenizer = Callable[[Column], Column]


def explode_tokens(df: DataFrame, tokens: str, keep: Sequence[str] = (), token: str = "token", pos: str | None = None) -> DataFrame:
    """One row per token.

    The outer form with a filter on its result: for the plain one Spark infers ``size(tokens) > 0`` and pushes it to the
    scan, where it would tokenise every text a second time.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(tokens).alias(token)).where(F.col(token).isNotNull())
    return df.select(*keep, F.posexplode_outer(tokens).alias(pos, token)).where(F.col(pos).isNotNull())


def whitespace(text: Column) -> Column:
    """Maximal runs of non-blank characters."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def words_and_marks(text: Column) -> Column:
    """Runs of ASCII word characters, and every other non-blank character on its own."""
    return F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACE}]"), F.lit(0))


TOKENIZERS: dict[str, Tokenizer] = {
    "whitespace": whitespace,
    "characters": characters,
    "words_and_marks": words_and_marks,
}


def get_tokenizer(tokenizer: str | Tokenizer) -> Tokenizer:
    return TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer


def plug_in(load: Callable[[], Callable[[str], Sequence[str]]]) -> Tokenizer:
    """UDF-02: tokeniser from a loader that runs once per Python worker; returns one text's tokens."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = load()
        for texts in batches:
            yield texts.map(lambda t: list(fn(t)) if t is not None else None)

    return F.pandas_udf(encode, T.ArrayType(T.StringType()), F.PandasUDFType.SCALAR_ITER)


def tokenize(df: DataFrame, text: str, tokenizer: str | Tokenizer = "whitespace", out: str = "tokens") -> DataFrame:
    """TOK-01: text -> array of tokens, no special tokens added."""
    return df.withColumn(out, get_tokenizer(tokenizer)(F.col(text)))


def token_lengths(df: DataFrame, tokens: str = "tokens", out: str = "n_tokens") -> DataFrame:
    """TOK-04."""
    return df.withColumn(out, F.size(tokens))


def build_vocab(df: DataFrame, tokens: str, size: int, specials: Sequence[str] = ()) -> DataFrame:
    """TOK-02: (token, token_id, n): specials first, then the most frequent tokens, ties by token.

    ``size`` bounds the result, so numbering it in one task is bounded too; counting is partial then final.
    """
    specials = list(dict.fromkeys(specials))
    counts = explode_tokens(df, tokens).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if specials:
        counts = counts.where(~F.col("token").isin(specials))
    top = counts.orderBy(F.desc("n"), "token").limit(max(size - len(specials), 0))
    ranked = top.select(
        "token",
        (F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1 + len(specials)).cast("int").alias("token_id"),
        "n",
    )
    head = df.sparkSession.createDataFrame(
        [(t, i, None) for i, t in enumerate(specials)], "token string, token_id int, n bigint"
    )
    return head.unionByName(ranked)


def _arrow_list_map(arr: pa.Array, fn: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Apply ``fn`` to the flat values of a (nested) list array and keep its shape."""
    if pa.types.is_list(arr.type) or pa.types.is_large_list(arr.type):
        lengths = pc.fill_null(pc.list_value_length(arr), 0)
        ends = pc.cumulative_sum(lengths.cast(pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        mask = pc.is_null(arr) if arr.null_count else None
        return pa.ListArray.from_arrays(offsets, _arrow_list_map(arr.flatten(), fn), mask=mask)
    return fn(arr)


# List elements that a worker handles at a time.
PIECE = 1 << 18


def leaf_offsets(arr: pa.Array) -> np.ndarray:
    """Where the elements of each row of a (nested) list array begin, and where the last row's end."""
    offsets, inner = arr.offsets.to_numpy(), arr.values
    while pa.types.is_list(inner.type) or pa.types.is_large_list(inner.type):
        offsets, inner = inner.offsets.to_numpy()[offsets], inner.values
    return offsets - offsets[0]


def pieces(batch: pa.RecordBatch, columns: Sequence[str], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most ``most`` list elements (a longer row alone): what a worker makes of them stays
    small, however many elements the rows of a batch have."""
    if not batch.num_rows:
        return
    ends = sum(leaf_offsets(batch.column(c)).astype(np.int64) for c in columns)
    row = 0
    while row < batch.num_rows:
        stop = max(int(np.searchsorted(ends, ends[row] + most, side="right")) - 1, row + 1)
        yield batch.slice(row, stop - row)
        row = stop


# A vocabulary of at most so many bytes of text goes to every worker; a larger one is joined.  Both give the same ids.
VOCAB_BYTES = 64_000_000


def _with_values(kind: T.DataType, value: T.DataType) -> T.DataType:
    return T.ArrayType(_with_values(kind.elementType, value)) if isinstance(kind, T.ArrayType) else value


def _looked_up(df: DataFrame, columns: dict[str, str], entries: DataFrame, default: Any, value: T.DataType, bound: int) -> DataFrame:
    """(Nested) list columns with every element replaced by its value in ``entries`` (key, value), else by ``default``."""
    size = entries.agg(F.sum(F.octet_length(F.col("key").cast("string")) + F.octet_length(F.col("value").cast("string")))).first()[0]
    key_type = pa.string() if isinstance(entries.schema["key"].dataType, T.StringType) else pa.int32()
    value_type = pa.string() if isinstance(value, T.StringType) else pa.int32()
    fields = [
        T.StructField(columns[f.name], _with_values(f.dataType, value)) if f.name in columns else f for f in df.schema.fields
    ]
    names = [f.name for f in fields]
    if (size or 0) > bound:
        return _looked_up_by_join(df, columns, entries, default, T.StructType(fields))
    rows = entries.toPandas()
    shared, name = df.sparkSession.sparkContext.broadcast((rows["key"].tolist(), rows["value"].tolist())), uuid4().hex

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("vocabulary", name, lambda: dict(zip(*shared.value, strict=True)))

        def of(flat: pa.Array) -> pa.Array:
            # each distinct element of a batch is looked up once
            coded = flat.cast(key_type).dictionary_encode()
            values = pa.array([known.get(key, default) for key in coded.dictionary.to_pylist()], value_type)
            return pc.fill_null(values.take(coded.indices), default) if default is not None else values.take(coded.indices)

        for whole in batches:
            for batch in pieces(whole, list(columns)):
                arrays = [_arrow_list_map(col, of) if name in columns else col for name, col in zip(batch.schema.names, batch.columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(lookup, T.StructType(fields))


def _looked_up_by_join(df: DataFrame, columns: dict[str, str], entries: DataFrame, default: Any, schema: T.StructType) -> DataFrame:
    """The same through a join: pieces of rows share a list of their distinct elements, and only these lists are joined.

    The rows are written with their elements' places in the piece's list, and meet its values once.
    """
    key = entries.schema["key"].dataType
    key_type, names, given = pa.string() if isinstance(key, T.StringType) else pa.int32(), schema.fieldNames(), df.columns
    kinds = [T.StructField(f.name, _with_values(f.dataType, T.IntegerType())) if f.name in columns else f for f in df.schema.fields]
    kinds = T.StructType([*kinds, T.StructField("_piece", T.StringType()), T.StructField("_keys", T.ArrayType(key))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, list(columns), 1 << 20):
                flats: list[pa.Array] = []

                def seen(flat: pa.Array) -> pa.Array:
                    flats.append(flat.cast(key_type))
                    return flat

                for c in columns:
                    _arrow_list_map(batch.column(c), seen)
                coded = pa.concat_arrays(flats).dictionary_encode()
                at = 0

                def place(flat: pa.Array) -> pa.Array:
                    nonlocal at
                    at += len(flat)
                    return coded.indices.slice(at - len(flat), len(flat))

                places = {c: _arrow_list_map(batch.column(c), place) for c in columns}
                arrays = [places.get(c, batch.column(c)) for c in batch.schema.names]
                keys = pa.array([coded.dictionary.to_pylist(), *[None] * (batch.num_rows - 1)], pa.list_(key_type))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([uuid4().hex] * batch.num_rows), keys], names=kinds.fieldNames())

    rows = written(df.mapInArrow(code, kinds), "coded")
    wanted = rows.where(F.col("_keys").isNotNull()).select("_piece", F.posexplode("_keys").alias("_place", "key"))
    found = wanted.join(entries, "key", "left").select(F.col("_piece").alias("_of"), "_place", "value")

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        _, first = np.unique(right.column("_place").to_numpy(), return_index=True)
        values = right.column("value").combine_chunks().take(pa.array(first))
        if default is not None:
            values = pc.fill_null(values, default)

        def of(flat: pa.Array) -> pa.Array:
            ids = values.take(flat)
            return ids if default is None else pc.fill_null(ids, default)

        left = left.select(given).combine_chunks()
        arrays = []
        for name, col in zip(left.schema.names, left.columns):
            col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
            arrays.append(_arrow_list_map(col, of) if name in columns else col)
        return pa.Table.from_arrays(arrays, names=names)

    return rows.drop("_keys").groupBy("_piece").cogroup(found.groupBy("_of")).applyInArrow(pick, schema)


def to_ids(
    df: DataFrame, tokens: str | dict[str, str], vocab: DataFrame, out: str | None = None, unk: str = UNK, bound: int = VOCAB_BYTES
) -> DataFrame:
    """JOIN-09: token arrays (nested or flat) become id arrays; tokens outside the vocabulary get the id of ``unk``.

    A vocabulary of at most ``bound`` bytes is shipped to the workers and looked up by hash inside each Arrow batch: no
    explode and no shuffle.  A larger one is joined, with the same result.  The id columns (``out``, or the values of a
    dict token column -> id column) replace the token columns; all other columns pass through Python as they are, so drop
    what is not needed first.
    """
    columns = {tokens: out} if isinstance(tokens, str) else dict(tokens)
    vocab = written(vocab.select("token", "token_id"), "vocab")  # it may take a count of all texts, and is read thrice
    default = vocab.where(F.col("token") == unk).select("token_id").first()
    entries = vocab.select(F.col("token").alias("key"), F.col("token_id").cast("int").alias("value"))
    return _looked_up(df, columns, entries, default and int(default[0]), T.IntegerType(), bound)


def to_ids_by_join(df: DataFrame, key: str, tokens: str, vocab: DataFrame, out: str, unk: str = UNK) -> DataFrame:
    """JOIN-09 by a join whatever the vocabulary's size; the token column stays next to the ids."""
    return to_ids(df.withColumn(out, F.col(tokens)), {out: out}, vocab, unk=unk, bound=-1)


def decode(
    df: DataFrame, ids: str, vocab: DataFrame, out: str, skip: int | None = None, sep: str = " ", bound: int = VOCAB_BYTES
) -> DataFrame:
    """TOK-03: ids -> text; positions equal to ``skip`` (the ignored label) are left out first.

    ``bound`` is that of :func:`to_ids`.
    """
    vocab = written(vocab.select("token", "token_id"), "vocab")
    source = F.col(ids) if skip is None else F.filter(ids, lambda x: x != F.lit(skip))
    entries = vocab.select(F.col("token_id").cast("int").alias("key"), F.col("token").alias("value"))
    named = _looked_up(df.withColumn(out, source.cast("array<int>")), {out: out}, entries, None, T.StringType(), bound)
    return named.withColumn(out, F.array_join(out, sep))


def preview(df: DataFrame, order: str, ids: str, vocab: DataFrame, labels: str | None = None) -> dict:
    """The first example decoded; no example at all is an error."""
    from corpusflow.schema import IGNORE

    first = df.orderBy(order).limit(1)
    first = decode(first, ids, vocab, "inputs_text")
    if labels:
        first = decode(first, labels, vocab, "labels_text", skip=IGNORE)
    row = first.first()
    if row is None:
        raise RuntimeError("no valid example: check the dataset format")
    return row.asDict()
