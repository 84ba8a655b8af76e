"""Layer scores from recorded hidden states: (run_id, target, layer, sample_id, token_pos, h_in, h_out)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.vectors import cosine, flat_doubles, residual_cosine


def layer_similarity(states: DataFrame, drop_norm: bool = True, skipped: DataFrame | None = None) -> DataFrame:
    """AGG-01: per layer the mean over samples of the mean cosine over the sample's tokens.

    ``drop_norm`` compares x with x + f(x), otherwise the normalised input with f.  Layers listed in ``skipped``
    (run_id, target, layer) get no row, which stands for minus infinity.
    """
    if skipped is not None:
        states = states.join(skipped, ["run_id", "target", "layer"], "left_anti")
    cos = residual_cosine("h_in", "h_out") if drop_norm else cosine("h_in", "h_out")
    return _mean_of_means(states.withColumn("_cos", cos))


def block_similarity(states: DataFrame) -> DataFrame:
    """AGG-02: the same two-level mean on whole-layer input and output."""
    return _mean_of_means(states.withColumn("_cos", cosine("h_in", "h_out")))


def _mean_of_means(df: DataFrame) -> DataFrame:
    per_sample = df.groupBy("run_id", "target", "layer", "sample_id").agg(F.avg("_cos").alias("_mean"))
    return per_sample.groupBy("run_id", "target", "layer").agg(F.avg("_mean").alias("score"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """AGG-04: per-device means of a layer averaged with equal weight (shares are equal by construction)."""
    return partials.groupBy("run_id", "target", "layer").agg(F.avg("score").alias("score"))


def layer_stack(states: DataFrame) -> DataFrame:
    """One row per token with its L + 1 states in layer order: the inputs of all layers and the last output.

    The number of layers is a property of the model, so a row is bounded; vectors are shuffled once.
    """
    stack = states.groupBy("run_id", "sample_id", "token_pos").agg(
        F.array_sort(F.collect_list(F.struct("layer", F.col("h_in").alias("h")))).alias("_in"),
        F.max_by("h_out", "layer").alias("_last"),
    )
    return stack.select(
        "run_id", "sample_id", "token_pos", F.concat(F.transform("_in", lambda s: s["h"]), F.array("_last")).alias("states")
    )


def gap_similarity(states: DataFrame) -> DataFrame:
    """JOIN-05, AGG-03: (run_id, layer, gap, score) for all layers i < j = i + gap, all tokens pooled.

    Each Arrow batch yields sums of cosines per (i, gap), so what is shuffled afterwards does not grow with the tokens.
    """
    stack = layer_stack(states).select("run_id", "states")
    schema = f"run_id {states.schema['run_id'].dataType.simpleString()}, layer int, gap int, total double, n bigint"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            runs, keys = np.asarray(codes.indices), codes.dictionary
            col = batch.column(1)
            depth = np.asarray(col.value_lengths(), dtype=np.int64)
            values, off = flat_doubles(col.flatten())
            first = np.concatenate(([0], np.cumsum(depth)))
            out: list[tuple] = []
            for g in range(len(keys)):
                for d in np.unique(depth[runs == g]):
                    rows = np.nonzero((runs == g) & (depth == d))[0]
                    width = off[first[rows[0]] + 1] - off[first[rows[0]]]
                    gram = np.zeros((d, d))
                    for part in range(0, len(rows), 128):  # bounds the working copy of the vectors
                        at = off[first[rows[part : part + 128]]][:, None] + np.arange(d * width)[None, :]
                        h = values[at].reshape(-1, d, width)
                        unit = h / np.maximum(np.sqrt((h * h).sum(axis=2, keepdims=True)), 1e-8)
                        gram += np.matmul(unit, unit.transpose(0, 2, 1)).sum(axis=0)
                    out.extend((g, i, j - i, gram[i, j], len(rows)) for i in range(d) for j in range(i + 1, d))
            if out:
                g, i, gap, total, n = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(g)),
                        pa.array(i, pa.int32()),
                        pa.array(gap, pa.int32()),
                        pa.array(total, pa.float64()),
                        pa.array(n, pa.int64()),
                    ],
                    names=["run_id", "layer", "gap", "total", "n"],
                )

    sums = stack.mapInArrow(partial, schema).groupBy("run_id", "layer", "gap")
    return sums.agg((F.sum("total") / F.sum("n")).alias("score"))
