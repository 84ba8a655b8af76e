"""From dataset names to encoded rows: the steps of the other modules in one call."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import examples as E
from corpusflow.operators import mixing as M
from corpusflow.operators.align import align
from corpusflow.operators.ordering import positions
from corpusflow.sources.cache import cached
from corpusflow.sources.readers import read_dataset, verify_checksums
from corpusflow.sources.registry import DatasetSpec

STRATEGIES = ("concat", "interleave_under", "interleave_over")


def load_dataset(spark: SparkSession, spec: DatasetSpec, root: str, schema: str | None = None, registry: DataFrame | None = None) -> DataFrame:
    """Rows of a registered dataset of files below ``root``.

    ``folder`` and ``subset`` of the entry name folders inside the dataset's own, so only their files are read.  With a
    ``registry`` table, files whose checksum differs are an error.
    """
    if spec.load_from not in ("file", "script") or not spec.location:
        raise ValueError(f"dataset {spec.name} is not a file or folder")
    path = os.path.join(root, spec.location, *[p for p in (spec.folder, spec.subset) if p])
    if registry is not None and spec.file_sha1:
        names = registry.select(F.col("location").alias("file_name"), "file_sha1")
        wrong = [r["status"] for r in verify_checksums(spark, path, names).select("status").distinct().collect() if r["status"] == "mismatch"]
        if wrong:
            raise ValueError(f"a file of {spec.name} has another checksum than registered")
    return read_dataset(spark, path, schema=schema)


def mix(
    rows: DataFrame,
    dataset: str,
    order: str,
    chunk: Column,
    strategy: str = "concat",
    probs: Sequence[float] | None = None,
    seed: int = 42,
    streaming: bool = False,
) -> DataFrame:
    """MIX-01 to MIX-04 by name, for rows of several datasets (numbered by ``dataset``).

    ``concat`` leaves the rows as they are.  The interleaving strategies add ``slot``; with ``probs`` each slot draws its
    dataset.  Streams are only concatenated here; see
    :func:`corpusflow.streaming.streams.stream_interleave`.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if streaming or rows.isStreaming:
        if strategy != "concat":
            raise ValueError("streams are mixed by concat here and by stream_interleave")
        return rows
    if strategy == "concat":
        return rows
    over = strategy == "interleave_over"
    if probs is not None:
        return M.interleave_probs(rows, dataset, order, chunk, probs, seed, over=over)
    return (M.interleave_over if over else M.interleave_under)(rows, dataset, order, chunk)


def split(rows: DataFrame, key: str, stage: str, val_size: float = 0, seed: int = 42, shuffle: bool = False) -> dict[str, DataFrame]:
    """Parts of the rows that a stage needs: ``train`` (shuffled on request, with ``slot``) and, with ``val_size``, ``test``.

    ``predict`` takes all rows as ``test``.  A stream's validation rows are its first ones, see
    :func:`corpusflow.streaming.streams.stream_take_skip`.
    """
    if rows.isStreaming:
        raise ValueError("a stream is split by stream_take_skip")
    if stage == "predict":
        return {"test": rows}
    if not val_size:
        return {"train": M.full_shuffle(rows, key, seed) if shuffle else rows}
    parts = M.train_test_split(rows, key, val_size, seed)
    train = parts.where("split = 'train'").drop("split")
    return {"train": M.full_shuffle(train, key, seed) if shuffle else train, "test": parts.where("split = 'test'").drop("split")}


def prepare(
    spark: SparkSession,
    specs: Sequence[DatasetSpec],
    root: str,
    stage: str,
    template: str,
    row_id: str,
    chunk: Column,
    vocab_size: int = 32_000,
    schema: str | None = None,
    registry: DataFrame | None = None,
    max_rows: int | None = None,
    strategy: str = "concat",
    cutoff: int | None = 1024,
    cache_path: str | None = None,
    read: Callable[[DatasetSpec], DataFrame] | None = None,
    schemas: Mapping[str, str] | None = None,
    probs: Sequence[float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Datasets read, checked, limited, aligned, mixed and encoded for a training stage; read from ``cache_path`` if there.

    ``row_id`` is a column of unique row numbers of every dataset; rows of the result are named by (dataset_idx, row_id)
    through ``example``, their number in the mixed order.  ``schemas`` gives datasets a schema of their own, by name;
    ``probs`` and ``seed`` are those of :func:`mix`; without ``cutoff`` examples are whole.
    """

    def build() -> DataFrame:
        parts = []
        for i, spec in enumerate(specs):
            rows = read(spec) if read else load_dataset(spark, spec, root, (schemas or {}).get(spec.name, schema), registry)
            if max_rows is not None:
                rows = M.take(rows, row_id, max_rows, chunk)
            parts.append(align(rows, spec, [row_id], "drop").withColumn("dataset_idx", F.lit(i)))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        mixed = mix(rows, "dataset_idx", row_id, chunk, strategy, probs, seed)
        if "slot" in mixed.columns:
            numbered = mixed.withColumnRenamed("slot", "example")
        else:  # dataset after dataset
            sizes = M._sizes(mixed, "dataset_idx").collect()  # one row per dataset given
            before = F.create_map(*[F.lit(x) for i in range(len(specs)) for x in (i, sum(r[1] for r in sizes if r[0] < i))])
            numbered = positions(mixed, ["dataset_idx"], [row_id], chunk, "_at")
            numbered = numbered.withColumn("example", F.element_at(before, F.col("dataset_idx")) + F.col("_at")).drop("_at")
        enc = E.make_encoding(numbered, template, vocab_size, has_tools=False)
        return E.build_examples(numbered, stage, enc, "example", cutoff)

    return build() if cache_path is None else cached(spark, cache_path, build)
