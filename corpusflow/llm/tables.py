"""Reading the given tables, bounded broadcasts and other helpers that all operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import broadcast_if_small, kept_by_worker, written

# Keys of at most this many rows (16 MB of longs) may be broadcast, after a count; beyond it the join is shuffled.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys`` (written or otherwise cheap to read)."""
    return df.join(broadcast_if_small(keys.select(on), BROADCAST_KEYS), on, "left_semi")


def tasks_for(df: DataFrame, per_task: int, least: int = 1) -> int:
    """Number of partitions that gives each at most about ``per_task`` rows of ``df`` (which should be cheap to count)."""
    return max(least, -(-df.count() // per_task))


def annotate(docs: DataFrame, column: str, fn: Callable[[pa.Array], list[pa.Array]], added: dict[str, T.DataType], most: int = 1_000_000, keeps: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` under the names c0, c1, ... and what ``fn`` makes of batches of ``column`` under the added names.

    The rows pass through the Python workers whole, so nothing has to be joined back; columns may have any names.
    ``keeps``: what ``fn`` keeps in the worker.
    """
    from corpusflow.llm.texts import slices

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at, out = f"c{docs.columns.index(column)}", [*names, *added]

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, most, keeps):
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch.column(at))], out)

    return plain.mapInArrow(per_batch, T.StructType([*plain.schema.fields, *[T.StructField(n, t) for n, t in added.items()]]))


def original(annotated: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The rows of ``annotated`` under the names they have in ``docs``, with added columns ``more`` behind them."""
    return annotated.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)], *more)


__all__ = ["BROADCAST_KEYS", "annotate", "broadcast_if_small", "kept_by_worker", "only_keys", "original", "table", "tasks_for", "written"]
