"""Token losses and perplexity, including a count-based stand-in for a model that sees a bounded context."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.tokenizers import explode_tokens, leaf_offsets, pieces
from corpusflow.operators.ordering import previous_value, running_totals
from corpusflow.session import broadcast_if_small, written


def token_stream(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, pos, token) from token arrays."""
    return explode_tokens(df, tokens, [key], pos="pos")


def _places(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every token of a list array: its row and its place there; and the tokens."""
    offsets = leaf_offsets(tokens)
    lengths = np.diff(offsets)
    return np.repeat(np.arange(len(tokens)), lengths), np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths), tokens.flatten()


def _kind(df: DataFrame, key: str, tokens: str, **more: T.DataType) -> T.StructType:
    """(key, pos, token, ...): a row per token of ``df``'s arrays."""
    fields = {key: df.schema[key].dataType, "pos": T.IntegerType(), "token": df.schema[tokens].dataType.elementType} | more
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def next_token_pairs(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """WIN-01 on token arrays: (key, pos, token, label) with the label inside the same row, so without a shuffle."""
    labels = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.arrays_zip(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))).alias("token"), labels.alias("label")
    )
    rows = explode_tokens(df.select(key, pairs.alias("_pairs")), "_pairs", [key], "p", "pos")
    return rows.select(key, "pos", "p.*")


def next_token_label(stream: DataFrame, key: str, pos: str, token: str, rows: int = 65_536, out: str = "label") -> DataFrame:
    """WIN-01 on a token table with dense positions, one window per chunk of each stream.

    The first row of a chunk is also handed to the chunk before it, where it only serves as a label.
    """
    at = F.floor(F.col(pos) / rows)
    copies = F.when((F.col(pos) % rows == 0) & (F.col(pos) > 0), F.array(at, at - 1)).otherwise(F.array(at))
    w = Window.partitionBy(key, "_chunk").orderBy(pos)
    lead = stream.withColumn("_chunk", F.explode(copies)).withColumn(out, F.lead(token).over(w))
    return lead.where((F.floor(F.col(pos) / rows) == F.col("_chunk")) & F.col(out).isNotNull()).drop("_chunk")


def perplexity(tokens: DataFrame, by: Sequence[str], nll: str = "nll", pos: str | None = None, first_n: int | None = None) -> DataFrame:
    """AGG-06: exp of the mean loss over the first ``first_n`` predicted tokens of each stream."""
    rows = tokens if first_n is None else tokens.where(F.col(pos) < first_n)
    return rows.groupBy(*by).agg(
        F.exp(F.avg(nll)).alias("ppl"), F.avg(nll).alias("mean_nll"), F.count(nll).alias("num_eval_tokens")
    )


def running_perplexity(tokens: DataFrame, by: Sequence[str], order: Sequence[str], nll: str, chunk: Column) -> DataFrame:
    """WIN-10: each step's exp(nll) and the perplexity of the stream so far."""
    counted = tokens.withColumn("_one", F.lit(1))
    totals = running_totals(counted, {"_sum": nll, "_cnt": "_one"}, by, order, chunk)
    return totals.select(
        *tokens.columns,
        F.exp(nll).alias("step_ppl"),
        F.exp(F.col("_sum") / F.col("_cnt")).alias("running_ppl"),
    )


def step_durations(df: DataFrame, by: Sequence[str], order: Sequence[str], ts: str, chunk: Column) -> DataFrame:
    """WIN-09: seconds since the step before; the first gap is the prefill, the others are decode steps."""
    lagged = previous_value(df, ts, by, order, chunk, "_prev", pos="_pos").where(F.col("_pos") > 0)
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))
    return (
        lagged.withColumn("seconds", micros / F.lit(1e6))
        .withColumn("phase", F.when(F.col("_pos") == 1, "prefill").otherwise("decode"))
        .drop("_prev", "_pos")
    )


def window_scored_nll(
    stream: DataFrame,
    key: str,
    pos: str,
    token: str,
    vocab_size: int | Column,
    start: int | None = None,
    recent: int | None = None,
    alpha: float = 1.0,
    rows: int = 65_536,
) -> DataFrame:
    """WIN-12: loss of each token under smoothed counts of the tokens visible before it.

    Visible at position i: the one before it, the ``recent`` ones before that and the first ``start`` ones (after each
    step the stream is cut to start + recent; the next token still sees the step itself).  ``recent=None`` sees all
    earlier tokens.  Streams are cut into chunks: a chunk also receives the rows its window reaches back to, and
    counts run per (stream, chunk, token), so neither a long stream nor a frequent token ends up in one task.
    """
    i = F.col(pos)
    if recent is None:
        seen = running_totals(
            stream.withColumn("_one", F.lit(1)), {"_seen": "_one"}, [key, token], [pos], F.floor(i / rows).cast("long"), True, True
        )
        counted = seen.withColumn("_count", F.col("_seen")).drop("_seen", "_one")
    else:
        span = recent + 1
        width = max(rows, span)
        at = F.floor(i / width)
        # Rows whose window of influence reaches into the next chunk are sent there too.
        copies = F.when(i % width >= width - span, F.array(at, at + 1)).otherwise(F.array(at))
        w = Window.partitionBy(key, "_chunk", token).orderBy(pos).rangeBetween(-span, -1)
        local = (
            stream.withColumn("_chunk", F.explode(copies))
            .withColumn("_near", F.count(F.lit(1)).over(w))
            .where(F.floor(i / width) == F.col("_chunk"))
            .drop("_chunk")
        )
        sinks = stream.where(i < start).groupBy(key, token).agg(F.array_sort(F.collect_list(pos)).alias("_sinks"))
        # At most ``start`` sink positions per stream; those inside the window are counted there already.  Few streams
        # mean few sinks, which are broadcast, so a long stream's frequent token does not meet in one task.
        joined = local.join(broadcast_if_small(written(sinks, "sinks")), [key, token], "left")
        far = F.coalesce(F.size(F.filter("_sinks", lambda s: s < i - span)), F.lit(0))
        counted = joined.withColumn("_count", F.col("_near") + far).drop("_near", "_sinks")
    return counted.where(i > 0).withColumn("nll", _smoothed(i, vocab_size, start, recent, alpha)).drop("_count")


def _smoothed(i: Column, vocab_size: int | Column, start: int | None, recent: int | None, alpha: float) -> Column:
    """The loss at position ``i`` of a token that was seen ``_count`` times before, where it is visible."""
    context = i if recent is None else F.least(i, F.lit(recent + 1)) + F.greatest(F.least(F.lit(start), i - (recent + 1)), F.lit(0))
    v = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    return -F.ln((F.col("_count") + F.lit(alpha)) / (context + F.lit(alpha) * v))


def _by_key(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is theirs alone, and those that share it, if there are any (NULL is a key, too)."""
    shared = df.groupBy(F.col(key).alias("_shared")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_shared")
    shared = written(shared, "shared")
    if shared.isEmpty():
        return df, None
    shared = broadcast_if_small(shared)
    same = df[key].eqNullSafe(shared["_shared"])
    return df.join(shared, same, "left_anti"), df.join(shared, same, "left_semi")


def window_scored_arrays(
    df: DataFrame, key: str, tokens: str, vocab_size: int | Column, start: int | None = None, recent: int | None = None, alpha: float = 1.0
) -> DataFrame:
    """WIN-12 on token arrays: (key, pos, token, nll) as :func:`window_scored_nll` has them, counted inside each row.

    No token is shuffled.  Arrays that share a key are one stream there, so these are left to it.
    """
    alone, rest = _by_key(df.select(key, tokens), key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, [tokens]):
                row, pos, flat = _places(batch.column(tokens))
                coded = flat.dictionary_encode(null_encoding="encode")
                group = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
                order = np.argsort(group, kind="stable")  # equal tokens of a row together, in order
                new = np.diff(group[order], prepend=-1) != 0
                first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                nth, seen = np.arange(len(order)), np.empty(len(order), np.int64)
                if recent is None:
                    seen[order] = nth - first
                else:
                    span, at = recent + 1, pos[order]
                    width = int(at.max(initial=0)) + 1
                    places = np.cumsum(new) * width + at
                    before = lambda p: np.searchsorted(places, places - at + np.clip(p, 0, at))
                    seen[order] = (nth - before(at - span)) + (before(np.minimum(start, at - span)) - first)
                at = np.flatnonzero(pos)
                columns = [batch.column(key).take(pa.array(row[at])), pa.array(pos[at], pa.int32()), flat.take(pa.array(at)), pa.array(seen[at])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "pos", "token", "_count"])

    counted = alone.mapInArrow(count, _kind(df, key, tokens, _count=T.LongType()))
    scored = counted.withColumn("nll", _smoothed(F.col("pos"), vocab_size, start, recent, alpha)).drop("_count")
    if rest is None:
        return scored
    return scored.unionByName(window_scored_nll(token_stream(rest, key, tokens), key, "pos", "token", vocab_size, start, recent, alpha))


Scorer = Callable[[pd.DataFrame], pd.Series]


def _losses(scorer: Scorer, key: str, pos: str, token: str, lists: str, segment: int, overlap: int | None):
    """The mapper from rows with a list ``lists`` of tokens to rows (key, pos, token, nll).

    Without ``overlap`` a row is a segment, with its number and the tokens' positions; with it, a whole stream.
    """

    def segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(row, first and last place among the batch's tokens, positions, which places are the segment's own)."""
        offsets = leaf_offsets(batch.column(lists)).tolist()
        for row, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
            if overlap is None:
                places = batch.column("_pos")[row].values.to_numpy()
                yield row, lo, hi, places, np.flatnonzero(places // segment == batch.column("_segment")[row].as_py())
            for at in range(0, 0 if overlap is None else hi - lo, segment):
                begin, end = max(at - overlap, 0), min(at + segment, hi - lo)
                yield row, lo + begin, lo + end, np.arange(begin, end), np.arange(at - begin, end - begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, [lists]):
                flat = batch.column(lists).flatten()
                values, found = flat.to_pandas().to_numpy(), []
                for row, lo, hi, places, own in segments(batch):
                    nll = scorer(pd.DataFrame({pos: places, token: values[lo:hi]})).to_numpy(float)
                    found.append((np.full(len(own), row), places[own], lo + own, nll[own]))
                if found:
                    rows, places, at, nll = (np.concatenate(x) for x in zip(*found))
                    columns = [batch.column(key).take(pa.array(rows)), pa.array(places), flat.take(pa.array(at)), pa.array(nll, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, pos, token, "nll"])

    return run


def score_streams(
    stream: DataFrame, key: str, pos: str, token: str, scorer: Scorer, segment: int = 4_096, overlap: int = 0
) -> DataFrame:
    """UDF-04: losses from a plug-in that gets one segment of a stream as a frame (pos, token), in order.

    Segments carry ``overlap`` earlier tokens as context; ``scorer`` returns one loss per row.  A stream is cut into
    segments of bounded size, so a long one is scored by many tasks.
    """
    i = F.col(pos)
    at = F.floor(i / segment).cast("long")
    copies = F.when((i % segment >= segment - overlap) & (F.lit(overlap) > 0), F.array(at, at + 1)).otherwise(F.array(at))
    if overlap > segment:
        raise ValueError("overlap must not exceed the segment")
    parts = stream.select(key, F.struct(pos, token).alias("_row"), F.explode(copies).alias("_segment"))
    parts = parts.groupBy(key, "_segment").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    lists = parts.select(key, "_segment", F.col("_rows").getField(pos).cast("array<long>").alias("_pos"), F.col("_rows").getField(token).alias("_tokens"))
    schema = T.StructType([stream.schema[key], T.StructField(pos, T.LongType()), stream.schema[token], T.StructField("nll", T.DoubleType())])
    found = lists.mapInArrow(_losses(scorer, key, pos, token, "_tokens", segment, None), schema)
    return found.withColumn(pos, F.col(pos).cast(stream.schema[pos].dataType))


def score_arrays(df: DataFrame, key: str, tokens: str, scorer: Scorer, segment: int = 4_096, overlap: int = 0) -> DataFrame:
    """UDF-04 on token arrays: (key, pos, token, nll) as :func:`score_streams` has them, without a shuffle of tokens.

    Arrays that share a key are one stream there, so these are left to it.
    """
    if overlap > segment:
        raise ValueError("overlap must not exceed the segment")
    alone, rest = _by_key(df.select(key, tokens), key)
    kind = _kind(df, key, tokens, nll=T.DoubleType())
    found = alone.mapInArrow(_losses(scorer, key, "pos", "token", tokens, segment, overlap), T.StructType([kind[0], T.StructField("pos", T.LongType()), *kind[2:]]))
    found = found.withColumn("pos", F.col("pos").cast("int"))
    return found if rest is None else found.unionByName(score_streams(token_stream(rest, key, tokens), key, "pos", "token", scorer, segment, overlap))
