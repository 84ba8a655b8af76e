"""Session helpers: a local test session, a shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Sequence
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of a join is broadcast only after its size proved to be at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def local_session(cores: str = "*", app: str = "corpusflow", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where a local session names none (tests on one machine) a temporary folder is made and set; executors on other
    machines could not read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: lengths of texts and (nested) values as JSON, eight bytes for the rest."""
    sizes = []
    for field in df.schema.fields:
        kind, value = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(value), F.lit(0)))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)))
    return F.lit(8 * len(df.columns)).cast("long") + sum(sizes, F.lit(0).cast("long"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the number of rows and their bytes are proved small; otherwise the plain (shuffled) side.

    ``df`` should be cheap to evaluate, e.g. the result of :func:`written`.
    """
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= max_rows and size["b"] <= max_bytes else df


def kept_by_worker(kind: str, name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker keeps from task to task and from query to query: the last one of each kind.

    A module of the process holds it, as functions that travel by value have globals of their own in every task.
    """
    held = vars(sys.modules.setdefault("corpusflow_worker_state", ModuleType("corpusflow_worker_state")))
    if kind not in held or held[kind][0] != name:
        held[kind] = (name, make())
    return held[kind][1]


def let_go(keeps: Sequence[str]) -> bool:
    """Forgets what this worker keeps of other kinds than ``keeps``; whether there was any."""
    held = vars(sys.modules.get("corpusflow_worker_state", ModuleType("")))
    others = [kind for kind in held if not kind.startswith("__") and kind not in keeps]
    for kind in others:
        del held[kind]
    return bool(others)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread the rows of a scan over the cluster when it has fewer splits than the cluster has cores.

    Meant for CPU-heavy text work on a table of few large row groups; a table with enough splits stays as it is.
    """
    if df.isStreaming or df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
