"""State that a stream carries from one micro-batch to the next, as tables in its folder.

A micro-batch reads what the batches before it wrote and writes under its own number, so a replayed one finds the same
state again and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.ordering import positions, whole_div
from corpusflow.session import broadcast_if_small, scratch_path


class KeyedCounts:
    """Sums per key over all micro-batches: a log of what changed, folded ``fold`` pieces at a time.

    A batch writes the keys that it has; every ``fold`` batches these pieces become one, as do ``fold`` of those.  So a
    changed key is written a logarithmic number of times, however many other keys there are, and a reader meets few pieces.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[T.StructField], fold: int = 16) -> None:
        self.spark, self.path, self.keys, self.fold = spark, path, [k.name for k in keys], fold
        self.schema = T.StructType([*keys, T.StructField("n", T.LongType())])

    def pieces(self, batches: int) -> list[tuple[int, int]]:
        """(level, number) of the pieces that hold the first so many batches."""
        out, level, units = [], 0, batches
        while units:
            out += [(level, i) for i in range(units - units % self.fold, units)]
            level, units = level + 1, units // self.fold
        return out

    def _read(self, pieces: Sequence[tuple[int, int]]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{level}-{i}" for level, i in pieces])

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum("n").alias("n"))

    def before(self, batch_id: int, keys: DataFrame | None = None) -> DataFrame:
        """(key, n) from all batches before this one, of the given keys only."""
        rows = self._read(self.pieces(batch_id))
        return self._sums(rows if keys is None else rows.join(broadcast_if_small(keys.select(*self.keys)), self.keys, "left_semi"))

    def add(self, batch_id: int, counts: DataFrame) -> DataFrame:
        """Write a batch's counts, fold what is full, and give the written counts."""
        counts.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/0-{batch_id}")
        level, units = 0, batch_id + 1
        while units % self.fold == 0:
            units //= self.fold
            whole = self._sums(self._read([(level, i) for i in range((units - 1) * self.fold, units * self.fold)]))
            level += 1
            whole.write.mode("overwrite").parquet(f"{self.path}/{level}-{units - 1}")
        return self._read([(0, batch_id)])


class Carry:
    """Rows that wait for a later micro-batch; each batch replaces the whole of them, so keep them few."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def after(self, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{batch_id}")

    def keep(self, batch_id: int, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")


def folder(spark: SparkSession, path: str | None, name: str) -> str:
    """The folder of a stream's results, checkpoint and state: the caller's, or a new one."""
    return scratch_path(spark, name) if path is None else path


def run_through(df: DataFrame, step: Callable[[DataFrame, int], DataFrame], path: str, schema: T.StructType, last: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """``step(rows, batch id)`` for each micro-batch, all results as one table; goes on where the last run in ``path`` ended.

    ``last(batch id)`` gives what is left to say once nothing more has arrived; a later run replaces it.
    """
    from corpusflow.streaming.streams import run_available

    seen: list[int] = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")
        seen.append(batch_id)

    run_available(df, sink, f"{path}/checkpoint")
    if seen and last is not None:
        last(max(seen)).write.mode("overwrite").parquet(f"{path}/out/batch_id=-1")
    schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return df.sparkSession.read.schema(schema).parquet(f"{path}/out")


_ALL = T.StructField("_all", T.IntegerType())


def in_groups(
    df: DataFrame, order: Sequence[str], chunk: Column, rows: int, step: Callable[[DataFrame], DataFrame], schema: T.StructType, path: str
) -> DataFrame:
    """``step`` over whole groups of ``rows`` consecutive records, whatever the triggers; ``_pos`` is a record's number.

    Micro-batch after micro-batch, and by ``order`` inside one, records are numbered; those of the last, unfinished group
    wait for the next batch, and the last ones go through ``step`` when the stream has ended.  If files arrive in the
    order of ``order``, the result is that of the whole table, and does not depend on how many files a trigger takes.
    """
    spark = df.sparkSession
    totals = KeyedCounts(spark, f"{path}/rows", [_ALL])
    carry = Carry(spark, f"{path}/carry", T.StructType([*df.schema.fields, T.StructField("_pos", T.LongType())]))

    def one(batch: DataFrame, batch_id: int) -> DataFrame:
        start = sum(r["n"] for r in totals.before(batch_id).collect())  # one row
        n = totals.add(batch_id, batch.agg(F.lit(0).alias("_all"), F.count(F.lit(1)).alias("n"))).first()["n"]
        placed = positions(batch, [], order, chunk, "_pos").withColumn("_pos", F.col("_pos") + start)
        every = carry.after(batch_id - 1).unionByName(placed)
        full = (start + n) // rows * rows
        # only the chunks that reach into the unfinished group are numbered for what waits
        last = positions(batch, [], order, chunk, "_pos", keep=lambda base, size, total: base + size + start > full)
        waiting = carry.after(batch_id - 1).unionByName(last.withColumn("_pos", F.col("_pos") + start))
        carry.keep(batch_id, waiting.where(F.col("_pos") >= full))
        return step(every.where(F.col("_pos") < full))

    return run_through(df, one, path, schema, lambda batch_id: step(carry.after(batch_id)))


def group_of(rows: int) -> Column:
    return whole_div(F.col("_pos"), rows)
