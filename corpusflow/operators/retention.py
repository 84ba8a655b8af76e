"""Bounded token streams: the first ``start`` and the last ``recent`` rows of each stream, and what they can see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ordering import positions


def retain_sink_recent(
    df: DataFrame, by: Sequence[str], order: Sequence[str], start: int, recent: int, chunk: Column
) -> DataFrame:
    """WIN-03: first ``start`` and last ``recent`` rows of each stream; all of a stream that fits.

    Adds ``pos`` and ``stream_len``.  Only the chunks at both ends of a stream are shuffled.
    """
    return retain_for_space(df, by, order, start, recent, 0, chunk)


def retain_for_space(
    df: DataFrame, by: Sequence[str], order: Sequence[str], start: int, recent: int, coming: int, chunk: Column
) -> DataFrame:
    """WIN-04: room for ``coming`` more: last ``recent - coming`` rows stay when the stream would not fit."""
    if not 0 <= coming <= recent:
        raise ValueError("coming rows must not exceed the recent window")

    def stays(first: Column, last: Column, total: Column) -> Column:
        return (total + coming <= start + recent) | (first < start) | (last >= total - (recent - coming))

    placed = positions(
        df, by, order, chunk, "pos", total="stream_len", keep=lambda base, rows, total: stays(base, base + rows - 1, total)
    )
    return placed.where(stays(F.col("pos"), F.col("pos"), F.col("stream_len")))


def evict_range(df: DataFrame, lo: Column | int, hi: Column | int, pos: str = "pos", layer_entry: str | None = None) -> DataFrame:
    """WIN-05: positions [lo, hi) removed; rows of layers without an entry (NULL) pass unchanged."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
    gone = (F.col(pos) >= lo) & (F.col(pos) < hi)
    if layer_entry:
        gone = gone & F.col(layer_entry).isNotNull()
    return df.where(~gone)


def cache_position(pos: Column, n_init: int, n_local: int) -> Column:
    """WIN-06: steady-state cache position of a token."""
    return F.when(pos < n_init, pos).otherwise(F.lit(n_init) + F.pmod(pos - n_init, F.lit(n_local)))


def live_positions(kept: DataFrame, by: Sequence[str], start: int, recent: int, pos: str = "pos", total: str = "stream_len") -> DataFrame:
    """WIN-06, live variant: rows kept by WIN-03 renumbered without gaps; new tokens continue at the cache length."""
    moved = F.when(F.col(total) <= start + recent, F.col(pos)).when(F.col(pos) < start, F.col(pos)).otherwise(
        F.col(pos) - (F.col(total) - recent) + start
    )
    return kept.withColumn("cache_pos", moved).withColumn("next_pos", F.least(F.col(total), F.lit(start + recent)))


def visible_ranges(df: DataFrame, pos: str, n_init: int, n_local: int) -> DataFrame:
    """JOIN-04: what a position sees, as two ranges: keys 0 to ``sink_end`` and ``local_start`` to itself.

    An end below 0, or a start behind the position, is an empty range.  One row per position, whatever the window.
    """
    i = F.col(pos).cast("long")
    return df.withColumn("sink_end", F.least(i, F.lit(n_init - 1).cast("long"))).withColumn(
        "local_start", F.greatest(F.lit(n_init).cast("long"), i - (n_local - 1))
    )


def visible_pairs(df: DataFrame, pos: str, n_init: int, n_local: int, out: str = "key_pos") -> DataFrame:
    """JOIN-04: one row per key a position sees, from :func:`visible_ranges`; for short windows or few positions.

    Keys are generated per row (at most n_init + n_local of them); nothing is joined.
    """
    empty = F.array().cast("array<bigint>")
    sinks = F.when(F.col("sink_end") >= 0, F.sequence(F.lit(0).cast("long"), F.col("sink_end"))).otherwise(empty)
    i = F.col(pos).cast("long")
    local = F.when(F.col("local_start") <= i, F.sequence(F.col("local_start"), i)).otherwise(empty)
    ranges = visible_ranges(df, pos, n_init, n_local)
    return ranges.withColumn(out, F.explode(F.concat(sinks, local))).drop("sink_end", "local_start")


def visible_count(pos: Column, n_init: int, n_local: int) -> Column:
    """WIN-07: number of keys visible from a position, in closed form."""
    sinks = F.least(pos + 1, F.lit(n_init))
    local = F.greatest(pos - F.greatest(F.lit(n_init), pos - (n_local - 1)) + 1, F.lit(0))
    return sinks + local


def sample_every(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, chunk: Column) -> DataFrame:
    """WIN-08: rows whose 1-based position divides by k."""
    return positions(df, by, order, chunk, "pos").where((F.col("pos") + 1) % k == 0)
