"""Row positions, running totals and neighbours in ordered data without single-task windows.

Every function takes a *chunk*: an expression that never decreases along the order (``id div 65536``, an hour
number, the first digits of a hash).  Counts or sums per (group, chunk) are pre-aggregated map-side, turned into
offsets over that small table, and the rows are then numbered inside their chunk only.  A group that holds a
third of the table is thereby spread over all of its chunks.

Group keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import broadcast_if_small, written

CHUNK_ROWS = 65_536


def whole_div(value: Column, by: int) -> Column:
    """Integer division, exact for ids beyond 2^53."""
    return F.call_function("div", value, F.lit(by)).cast("long")


def id_chunk(col: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a unique integer id: at most ``rows`` rows each."""
    return whole_div(F.col(col) if isinstance(col, str) else col, rows)


def time_chunk(col: str | Column, seconds: int = 86_400) -> Column:
    """Chunk of a timestamp (with or without zone)."""
    ts = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(seconds)).cast("long")


def hash_chunk(col: str | Column, digits: int = 4) -> Column:
    """Chunk of a hexadecimal hash: its first digits, uniform by construction."""
    return F.substring(F.col(col) if isinstance(col, str) else col, 1, digits)


CUTS = 512  # bounds the size of the expression below


def even_chunk(df: DataFrame, col: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of any numeric column from approximate quantiles, for ids that are unevenly spread.

    Up to ``CUTS`` ranges hold equally many rows; a larger table divides each of them evenly by value.
    """
    n = df.count()
    parts = max(1, -(-n // rows))
    if parts == 1:
        return F.lit(0).cast("long")
    wide, fine = min(parts, CUTS), -(-parts // CUTS)
    shares = [i / wide for i in range(wide + 1)]
    cuts = sorted(set(df.agg(F.percentile_approx(col, shares, max(10_000, 10 * wide)).alias("q")).first()["q"]))
    value = F.col(col)

    def inside(i: int) -> Column:
        """The chunk of a value between cuts i and i + 1; values beyond the outer cuts go to the outer chunks."""
        if fine == 1 or cuts[i + 1] <= cuts[i]:
            return F.lit(i * fine)
        share = (value.cast("double") - F.lit(float(cuts[i]))) / F.lit(float(cuts[i + 1] - cuts[i]))
        return F.lit(i * fine) + F.greatest(F.least(F.floor(share * fine), F.lit(fine - 1)), F.lit(0))

    def pick(lo: int, hi: int) -> Column:  # balanced comparison tree over the cut points
        if lo == hi:
            return inside(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid + 1]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(cuts) - 2).cast("long") if len(cuts) > 1 else F.lit(0).cast("long")


def hex_hash(seed: int, *cols: str | Column) -> Column:
    """``md5(seed:col:…)`` as text; the same in every engine, so draws are reproducible."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def unit_hash(seed: int, *cols: str | Column) -> Column:
    """Uniform double in [0, 1) from 52 hash bits."""
    return F.conv(F.substring(hex_hash(seed, *cols), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


# Chunks that one task adds up where a whole table is one order.
CHUNKS_PER_TASK = 4_096


def _before(sums: DataFrame, by: Sequence[str], outs: dict[str, str], whole: dict[str, str] | None = None) -> DataFrame:
    """``sums``, one row per (group, chunk), with sums over the group's chunks before it (output name -> input column).

    They are NULL in the first chunk.  ``whole`` names sums over all of the group's chunks.  Groups are summed each in one task.  Without groups, runs of consecutive chunks are:
    only the totals of runs meet in one task, a few thousandths of the chunks.
    """

    whole = whole or {}

    def along(df: DataFrame, group: Sequence, order: str, values: dict[str, str], all_: dict[str, str]) -> DataFrame:
        group = Window.partitionBy(*group)
        w = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.sum(v).over(w).alias(o) for o, v in values.items()], *[F.sum(v).over(group).alias(o) for o, v in all_.items()])

    if by or not isinstance(sums.schema["_chunk"].dataType, T.IntegralType):
        return along(sums, list(by) or [F.lit(0)], "_chunk", outs, whole)
    runs = sums.withColumn("_run", whole_div(F.col("_chunk"), CHUNKS_PER_TASK))
    totals = runs.groupBy("_run").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in (outs | whole).items()])
    totals = along(totals, [F.lit(0)], "_run", {f"_r_{o}": f"_t_{o}" for o in outs}, {o: f"_t_{o}" for o in whole})
    totals = totals.select("_run", *[f"_r_{o}" for o in outs], *whole)
    inside = along(runs, ["_run"], "_chunk", {f"_i_{o}": v for o, v in outs.items()}, {}).join(totals, "_run")
    both = lambda o: F.when(F.coalesce(f"_i_{o}", f"_r_{o}").isNotNull(), F.coalesce(f"_i_{o}", F.lit(0)) + F.coalesce(f"_r_{o}", F.lit(0)))
    return inside.select(*sums.columns, *[both(o).alias(o) for o in outs], *whole)


def _offsets(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per (group, chunk): total of the chunks before it, its own total and the group's."""
    based = _before(counts, by, {"_b": value}, {"_total": value})
    return based.select(*by, "_chunk", F.coalesce("_b", F.lit(0)).alias("_base"), F.col(value).alias("_rows"), "_total")


def positions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    out: str = "pos",
    total: str | None = None,
    keep: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """0-based position of every row in its group.

    ``keep(base, rows, total)`` may name the chunks that matter (first position, size, group size); the others are
    dropped before the rows are shuffled.  The chunk table is then written once and broadcast if it is small.
    """
    by = list(by)
    tagged = df.withColumn("_chunk", chunk)
    offsets = _offsets(tagged.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n")), by, "_n")
    if keep is not None:
        offsets = broadcast_if_small(
            written(offsets.where(keep(F.col("_base"), F.col("_rows"), F.col("_total"))), "offsets")
        )
    w = Window.partitionBy(*by, "_chunk").orderBy(*order)
    result = tagged.join(offsets, [*by, "_chunk"]).withColumn(out, F.row_number().over(w) - 1 + F.col("_base"))
    if total:
        result = result.withColumn(total, F.col("_total"))
    return result.drop("_chunk", "_base", "_rows", "_total")


def running_total(
    df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], chunk: Column, out: str, exclusive: bool = False
) -> DataFrame:
    """Running sum of ``value`` along the order of each group."""
    return running_totals(df, {out: value}, by, order, chunk, exclusive)


def running_totals(
    df: DataFrame,
    values: dict[str, str],
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    exclusive: bool = False,
    mostly_short: bool = False,
) -> DataFrame:
    """Several running sums (output name -> input column) with one shuffle of the rows.

    ``mostly_short`` says that few groups have more than one chunk: the bases of later chunks are then written once and,
    if few, broadcast.
    """
    by = list(by)
    tagged = df.withColumn("_chunk", chunk)
    sums = tagged.groupBy(*by, "_chunk").agg(*[F.sum(v).alias(f"_s_{o}") for o, v in values.items()])
    bases = _before(sums, by, {f"_b_{o}": f"_s_{o}" for o in values}).select(*by, "_chunk", *[f"_b_{o}" for o in values])
    bases = bases.where(F.coalesce(*[F.col(f"_b_{o}") for o in values]).isNotNull())  # first chunks start from nothing
    if mostly_short:
        bases = broadcast_if_small(written(bases, "bases"))
    w = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = tagged.join(bases, [*by, "_chunk"], "left")

    def total(o: str, v: str) -> Column:
        value = F.sum(v).over(w) + F.coalesce(F.col(f"_b_{o}"), F.lit(0))
        return (value - F.col(v) if exclusive else value).alias(o)

    return joined.select(*df.columns, *[total(o, v) for o, v in values.items()])


def previous_value(
    df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], chunk: Column, out: str, pos: str | None = None
) -> DataFrame:
    """``lag(value)`` along the order of each group; the last value of the chunk before is carried over.

    ``pos`` names a column for the row's 0-based position, which comes with the same shuffle.
    """
    by = list(by)
    tagged = df.withColumn("_chunk", chunk)
    last = tagged.groupBy(*by, "_chunk").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    chunks = group.orderBy("_chunk")
    carry = last.select(
        *by,
        "_chunk",
        F.lag("_last").over(chunks).getField("v").alias("_carry"),
        (F.sum("_n").over(chunks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"),
    )
    w = Window.partitionBy(*by, "_chunk").orderBy(*order)
    nth = F.row_number().over(w)
    result = tagged.join(carry, [*by, "_chunk"]).withColumn(
        out, F.when(nth == 1, F.col("_carry")).otherwise(F.lag(value).over(w))
    )
    if pos:
        result = result.withColumn(pos, nth - 1 + F.col("_base"))
    return result.drop("_chunk", "_carry", "_base")


def nth_key(df: DataFrame, keys: Sequence[str], n: int, chunk: Column) -> DataFrame:
    """One row ``key``: the n-th smallest key (1-based), or the largest when there are fewer rows.

    Only the chunk that holds it is sorted, so a filter ``key <= nth`` takes the first n rows of any table
    without shuffling its payload.
    """
    rows = df.select(F.struct(*keys).alias("key"), chunk.alias("_chunk"))
    counts = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, [], "_n").where(
        (F.col("_base") < F.least(F.lit(n), F.col("_total")))
        & (F.col("_base") + F.col("_rows") >= F.least(F.lit(n), F.col("_total")))
    )
    w = Window.partitionBy("_chunk").orderBy("key")
    ranked = rows.join(F.broadcast(offsets), "_chunk")  # one row: the chunk of the n-th key
    ranked = ranked.withColumn("_rn", F.row_number().over(w) + F.col("_base"))
    return ranked.where(F.col("_rn") == F.least(F.lit(n), F.col("_total"))).select("key")


def first_rows(df: DataFrame, order: Sequence[str], n: int, chunk: Column) -> DataFrame:
    """The first n rows by a unique key."""
    if n <= 0:
        return df.limit(0)
    return df.where(F.struct(*order) <= nth_key(df, order, n, chunk).scalar())


def rows_after(df: DataFrame, order: Sequence[str], n: int, chunk: Column) -> DataFrame:
    """All rows but the first n by a unique key."""
    if n <= 0:
        return df
    return df.where(F.struct(*order) > nth_key(df, order, n, chunk).scalar())


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact interpolated median per group.

    A quantile sketch of bounded size brackets the middle; only the (pre-counted) distinct values inside the bracket
    are ranked, so no task ever holds a whole group.
    """
    by = list(by)
    acc, eps = 10_000, 3e-4
    bracket = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.percentile_approx(value, [0.5 - eps, 0.5 + eps], acc).alias("_q"),
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_lo0"),
        F.max(value).alias("_hi0"),
    )
    # Groups smaller than the sketch are ranked whole.
    bracket = bracket.select(
        *by,
        "_n",
        F.when(F.col("_n") < acc, F.col("_lo0")).otherwise(F.col("_q")[0]).alias("_lo"),
        F.when(F.col("_n") < acc, F.col("_hi0")).otherwise(F.col("_q")[1]).alias("_hi"),
    )
    bracket = broadcast_if_small(written(bracket, "bracket"))
    counted = df.where(F.col(value).isNotNull()).select(*by, value).join(bracket, by)
    counted = counted.where(F.col(value) <= F.col("_hi")).select(
        *by, "_n", F.when(F.col(value) < F.col("_lo"), F.lit(None)).otherwise(F.col(value)).alias("_v")
    )
    counted = counted.groupBy(*by, "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_end", F.sum("_c").over(w))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    start = F.col("_end") - F.col("_c")
    return ranked.groupBy(*by).agg(
        (
            (
                F.max(F.when((start < low) & (F.col("_end") >= low), F.col("_v")))
                + F.max(F.when((start < high) & (F.col("_end") >= high), F.col("_v")))
            )
            / 2
        ).alias(out)
    )
