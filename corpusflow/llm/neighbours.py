"""Each row with the row next to it in the order of a whole table, without one task seeing the table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import tasks_for, written
from corpusflow.llm.texts import slices

ROWS_PER_CHUNK = 10_000
MOST_CHUNKS = 4_096  # bounds the tables below; chunks of a very large table hold more rows, which stream through


def _chunk(cuts: list, of: Column) -> Column:
    """How many of the sorted cut points are smaller than ``of``."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(of <= F.lit(cuts[mid]), _chunk(cuts[:mid], of)).otherwise(_chunk(cuts[mid + 1 :], of) + (mid + 1))


def with_next(
    df: DataFrame, order: str, schema: T.StructType, make: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch],
    text: str = "text", rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``make(rows, next rows)`` for all rows in descending ``order`` (an integer column); the last row's next is the first.

    The table is cut at quantiles of ``order``.  A chunk also gets a copy of the first row of the
    chunk behind it, so chunks are independent; each holds a few MB of ``text`` at a time.  Rows of equal order stand side by
    side in the order of all their columns, null orders at the end.  A single row is its own next.
    """
    ids = written(df.select(F.col(order).alias("o")), "order")
    parts = min(tasks_for(ids, rows_per_chunk), MOST_CHUNKS)
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted({x for x in (ids.agg(F.percentile_approx("o", shares, 10_000)).first()[0] or []) if x is not None}) if shares else []
    # descending: chunk 0 holds the largest; nulls come last of all
    place = F.when(F.col("o").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _chunk(cuts, F.col("o")))
    heads = ids.select("o", place.alias("chunk")).groupBy("chunk").agg(F.max("o").alias("o"))
    along = Window.partitionBy(F.lit(0)).orderBy("chunk")  # one row per chunk
    before = F.coalesce(F.lag("chunk").over(along), F.max("chunk").over(Window.partitionBy(F.lit(0))))
    heads = heads.select("chunk", F.col("o").alias("head"), before.alias("before"))
    tagged = df.withColumn("o", F.col(order)).withColumn("chunk", place)
    guests = tagged.join(F.broadcast(heads), ["chunk"]).where(F.col("o").eqNullSafe(F.col("head")))
    columns = df.columns
    own = tagged.select(*columns, "chunk", F.lit(0).alias("guest"))
    dealt = own.union(guests.select(*columns, F.col("before").alias("chunk"), F.lit(1).alias("guest")))
    rest = [F.col(c).asc() for c in columns if c != order]
    dealt = dealt.repartition("chunk").sortWithinPartitions("chunk", "guest", F.col(order).desc_nulls_last(), *rest)

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row that waits for its next
        for batch in slices(batches, text):
            table = pa.Table.from_batches([last, batch] if last is not None else [batch]).combine_chunks()
            rows = table.to_batches()[0] if table.num_rows else batch
            if not rows.num_rows:
                continue
            chunk, guest = rows.column("chunk").to_pylist(), rows.column("guest").to_pylist()
            keep = [i for i in range(rows.num_rows - 1) if not guest[i] and chunk[i] == chunk[i + 1]]
            if keep:
                yield make(rows.take(pa.array(keep)), rows.take(pa.array([i + 1 for i in keep])))
            last = rows.slice(rows.num_rows - 1)

    return dealt.mapInArrow(pairs, schema)
