"""Mixing, sampling, splitting and shuffling of datasets, reproducible through hashes of row keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.ordering import (
    first_rows,
    hash_chunk,
    hex_hash,
    nth_key,
    positions,
    rows_after,
    unit_hash,
    whole_div,
)

WRAP_BLOCK = 65_536


def limit_per_dataset(df: DataFrame, dataset: str, order: str, n: int, chunk: Column) -> DataFrame:
    """SRC-08: first min(n, size) rows of each dataset; chunks beyond row n are dropped before the shuffle."""
    if df.isStreaming:
        raise ValueError("a sample limit is incompatible with streaming")
    placed = positions(df, [dataset], [order], chunk, "_pos", keep=lambda base, rows, total: base < n)
    return placed.where(F.col("_pos") < n).drop("_pos")


def mix_concat(dfs: Sequence[DataFrame]) -> DataFrame:
    """MIX-01: append in order; ``dataset_idx`` tells the source. A single dataset is returned as it is."""
    if len(dfs) == 1:
        return dfs[0]
    result = None
    for i, df in enumerate(dfs):
        part = df.withColumn("dataset_idx", F.lit(i))
        result = part if result is None else result.unionByName(part)
    return result


def _sizes(df: DataFrame, dataset: str) -> DataFrame:
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("_len"))


def interleave_under(df: DataFrame, dataset: str, order: str, chunk: Column) -> DataFrame:
    """MIX-02: round-robin over ``dataset`` numbers until the first is exhausted; ``slot`` is the new order."""
    sizes = _sizes(df, dataset)
    rounds = sizes.agg(F.min("_len")).scalar()
    k = sizes.agg(F.count(F.lit(1))).scalar()
    placed = positions(df, [dataset], [order], chunk, "_rn").where(F.col("_rn") < rounds)
    return placed.withColumn("slot", F.col("_rn") * k + F.col(dataset)).drop("_rn")


def interleave_over(df: DataFrame, dataset: str, order: str, chunk: Column) -> DataFrame:
    """MIX-03: round-robin until all are exhausted; short datasets start again.

    Each row emits its own repetitions (slots ``rn``, ``rn + len``, …), so nothing is joined.  Rows repeated very often
    are first expanded to blocks of repetitions that are spread over the cluster.
    """
    sizes = _sizes(df, dataset)
    rounds = sizes.agg(F.max("_len")).scalar()
    k = sizes.agg(F.count(F.lit(1))).scalar()
    placed = positions(df, [dataset], [order], chunk, "_rn", total="_len").withColumn(
        "_copies", F.floor((rounds - 1 - F.col("_rn")) / F.col("_len")) + 1
    )
    few = placed.where(F.col("_copies") <= WRAP_BLOCK).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    )
    many = (
        placed.where(F.col("_copies") > WRAP_BLOCK)
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / WRAP_BLOCK))))
        .repartition(dataset, "_rn", "_b")
        .withColumn(
            "_c",
            F.explode(
                F.sequence(
                    F.col("_b") * WRAP_BLOCK, F.least((F.col("_b") + 1) * WRAP_BLOCK, F.col("_copies")) - 1
                )
            ),
        )
        .drop("_b")
    )
    slot = (F.col("_rn") + F.col("_c") * F.col("_len")) * k + F.col(dataset)
    return few.unionByName(many).withColumn("slot", slot).drop("_rn", "_len", "_copies", "_c")


def drawn_slots(spark, first: int, n_slots: int, probs: Sequence[float], seed: int) -> DataFrame:
    """Which dataset each of ``n_slots`` slots from ``first`` on draws (``source``), from a hash of the slot number."""
    total = float(sum(probs))
    edges, acc = [], 0.0
    for p in probs[:-1]:
        acc += p / total
        edges.append(acc)
    u = unit_hash(seed, F.col("slot").cast("string"))
    pick = F.lit(len(probs) - 1)
    for i in reversed(range(len(edges))):
        pick = F.when(u < edges[i], F.lit(i)).otherwise(pick)
    return spark.range(first, first + n_slots).withColumnRenamed("id", "slot").withColumn("source", pick)


def interleave_probs(
    df: DataFrame, dataset: str, order: str, chunk: Column, probs: Sequence[float], seed: int, over: bool = False
) -> DataFrame:
    """MIX-04: each slot draws a dataset with the given probability.

    Stops with the slot that exhausts the first dataset (``over``: the last one, shorter ones start again).  Slots are
    generated until that stop is inside them, then joined with the rows on (dataset, row number): unique keys, no skew.
    """
    spark = df.sparkSession
    placed = positions(df, [dataset], [order], chunk, "_rn")
    sizes = {r[0]: r[1] for r in _sizes(df, dataset).collect()}  # one row per dataset given
    lengths = [sizes.get(i, 0) for i in range(len(probs))]
    if min(lengths) == 0:
        raise ValueError("every dataset needs at least one row")
    if min(probs) <= 0:
        raise ValueError("probabilities must be positive")
    total = float(sum(probs))
    need = [n / (p / total) for n, p in zip(lengths, probs)]
    n_slots = int((max(need) if over else min(need)) * 1.1) + 1000
    while True:
        draws = drawn_slots(spark, 0, n_slots, probs, seed)
        drawn = positions(draws, ["source"], ["slot"], whole_div(F.col("slot"), WRAP_BLOCK), "_k")
        length_of = F.element_at(F.array(*[F.lit(n) for n in lengths]), (F.col("source") + 1).cast("int"))
        ends = drawn.where(F.col("_k") == length_of - 1).agg(
            F.count(F.lit(1)).alias("done"), (F.max("slot") if over else F.min("slot")).alias("stop")
        ).first()
        if ends["done"] == len(probs) or (ends["done"] and not over):
            break
        n_slots *= 2
    # Without ``over`` a dataset not exhausted inside the slots ends later than the stop found, so the minimum is exact.
    # Rows of a dataset that starts again many times are copied, one copy for about WRAP_BLOCK slots, or all its slots would
    # meet one key.
    copies = [max(1, -(-int(n_slots * p / total / n) // WRAP_BLOCK)) if over else 1 for n, p in zip(lengths, probs)]
    salts = F.element_at(F.array(*[F.lit(c) for c in copies]), (F.col("source") + 1).cast("int"))
    used = drawn.where(F.col("slot") <= ends["stop"]).select(
        "slot", "source", (F.col("_k") % length_of).alias("_rn"), (F.floor(F.col("_k") / length_of) % salts).cast("int").alias("_salt")
    )
    rows = placed.withColumnRenamed(dataset, "source").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return used.join(rows, ["source", "_rn", "_salt"]).withColumnRenamed("source", dataset).drop("_rn", "_salt")


def train_test_split(df: DataFrame, key: str, size: float, seed: int, out: str = "split") -> DataFrame:
    """MIX-05: ``size`` > 1 is the number of test rows, otherwise their share (rounded up).

    The split is a filter against the n-th smallest key hash; rows are not shuffled.
    """
    hashed = df.withColumn("_h", hex_hash(seed, key))
    if size > 1:
        n = int(size)
    else:
        n = math.ceil(df.count() * size - 1e-9)
    if n <= 0:
        return df.withColumn(out, F.lit("train"))
    limit = nth_key(hashed, ["_h", key], n, hash_chunk("_h")).scalar()
    return hashed.withColumn(out, F.when(F.struct("_h", key) <= limit, "test").otherwise("train")).drop("_h")


def take(df: DataFrame, order: str, n: int, chunk: Column) -> DataFrame:
    """MIX-06: the first n rows."""
    return first_rows(df, [order], n, chunk)


def skip(df: DataFrame, order: str, n: int, chunk: Column) -> DataFrame:
    """MIX-06: all but the first n rows."""
    return rows_after(df, [order], n, chunk)


def buffered_shuffle(df: DataFrame, row: str, key: str, seed: int, buffer: int = 16_384, out: str = "slot") -> DataFrame:
    """MIX-07: hash order inside consecutive buffers; ``row`` is the dense row number, ``out`` the new one."""
    buf = whole_div(F.col(row), buffer)
    w = Window.partitionBy("_buf").orderBy("_h", key)
    return (
        df.withColumn("_buf", buf)
        .withColumn("_h", hex_hash(seed, key))
        .withColumn(out, F.col("_buf") * buffer + F.row_number().over(w) - 1)
        .drop("_buf", "_h")
    )


def full_shuffle(df: DataFrame, key: str, seed: int, out: str = "slot") -> DataFrame:
    """MIX-07 with an unbounded buffer: position in hash order over the whole table."""
    hashed = df.withColumn("_h", hex_hash(seed, key))
    return positions(hashed, [], ["_h", key], hash_chunk("_h"), out).drop("_h")


def calibration_sample(df: DataFrame, order: str, n: int, workers: int, chunk: Column) -> DataFrame:
    """MIX-08: the first n rows, dealt in turn to ``workers``; n must divide evenly and exist."""
    if n % workers:
        raise ValueError("the number of samples must divide evenly among the workers")
    total = df.agg(F.count(F.lit(1))).scalar()
    enough = F.when(total >= n, F.lit(True)).otherwise(
        F.raise_error(F.lit("more calibration samples than rows")).cast("boolean")
    )
    picked = first_rows(df, [order], n, chunk).where(enough)
    placed = positions(picked, [], [order], chunk, "sample")
    return placed.withColumn("worker", F.pmod(F.col("sample"), F.lit(workers)).cast("int"))
