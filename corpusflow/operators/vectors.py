"""Vector arithmetic: Arrow batches and numpy inside tasks, Spark for partitioning and aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_doubles(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values (as float64) and offsets of a list array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    lengths = np.asarray(arr.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(arr.flatten(), dtype=np.float64), np.concatenate(([0], np.cumsum(lengths)))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each list; 0 for empty ones."""
    if len(offsets) == 1:
        return np.zeros(0)
    sums = np.add.reduceat(np.append(values, 0.0), offsets[:-1])
    sums[offsets[:-1] == offsets[1:]] = 0.0
    return sums


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two equally long vectors, the norm product bounded below by 1e-8."""
    x, off = flat_doubles(a)
    y, off_y = flat_doubles(b)
    if not np.array_equal(off, off_y):
        raise ValueError("vectors of different length")
    norm = np.maximum(np.sqrt(segment_sums(x * x, off)), 1e-8) * np.maximum(np.sqrt(segment_sums(y * y, off)), 1e-8)
    return pa.array(segment_sums(x * y, off) / norm, pa.float64(), mask=np.asarray(a.is_null()) | np.asarray(b.is_null()))


@F.arrow_udf(T.DoubleType())
def residual_cosine(a: pa.Array, f: pa.Array) -> pa.Array:
    """Cosine of x and x + f."""
    x, off = flat_doubles(a)
    y, off_y = flat_doubles(f)
    if not np.array_equal(off, off_y):
        raise ValueError("vectors of different length")
    y = x + y
    norm = np.maximum(np.sqrt(segment_sums(x * x, off)), 1e-8) * np.maximum(np.sqrt(segment_sums(y * y, off)), 1e-8)
    return pa.array(segment_sums(x * y, off) / norm, pa.float64(), mask=np.asarray(a.is_null()) | np.asarray(f.is_null()))


@F.arrow_udf(T.DoubleType())
def token_nll(logits: pa.Array, label: pa.Array) -> pa.Array:
    """AGG-05: log-sum-exp of the scores minus the label's score (labels count from 0)."""
    x, off = flat_doubles(logits)
    n = len(off) - 1
    if n == 0:
        return pa.array([], pa.float64())
    peak = np.maximum.reduceat(np.append(x, -np.inf), off[:-1])
    shifted = np.exp(x - np.repeat(peak, np.diff(off)))
    at = np.asarray(label.fill_null(-1), dtype=np.int64)
    bad = (at < 0) | (at >= np.diff(off))
    value = peak + np.log(segment_sums(shifted, off)) - x[np.where(bad, 0, off[:-1] + at)]
    return pa.array(value, pa.float64(), mask=bad)


def softmax_matrix(scores: pa.Array) -> np.ndarray:
    """Row-wise softmax of equally long score lists."""
    x, off = flat_doubles(scores)
    width = off[1] - off[0] if len(off) > 1 else 0
    if len(off) > 1 and not (np.diff(off) == width).all():
        raise ValueError("score vectors of different length")
    m = x.reshape(len(off) - 1, width)
    e = np.exp(m - m.max(axis=1, keepdims=True)) if m.size else m
    return e / e.sum(axis=1, keepdims=True) if m.size else e


def _top_k(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    idx = np.argsort(-p, axis=1, kind="stable")[:, :k]
    return idx, np.take_along_axis(p, idx, axis=1)


ROUTES = T.StructType(
    [T.StructField("experts", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]
)


def topk_routing(df: DataFrame, scores: str, k: int, normalise: bool = True, out: str = "route") -> DataFrame:
    """AGG-17: struct(experts, weights): softmax, best k (ties: lower expert), weights renormalised if k > 1."""

    @F.arrow_udf(ROUTES)
    def route(col: pa.Array) -> pa.Array:
        p = softmax_matrix(col)
        idx, weight = _top_k(p, k)
        if k > 1 and normalise:
            weight = weight / (weight.sum(axis=1, keepdims=True) + 1e-20)
        offsets = pa.array(np.arange(len(idx) + 1, dtype=np.int32) * idx.shape[1])
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(idx.ravel().astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(weight.ravel())),
            ],
            names=["experts", "weights"],
        )

    return df.withColumn(out, route(F.col(scores)))


def _expert_sums(df: DataFrame, scores: str, k: int, seq: str | None) -> DataFrame:
    """Per Arrow batch (and sequence): score sum, picks and rows of each expert, pre-aggregated before any shuffle."""
    key_type = df.schema[seq].dataType if seq else T.LongType()
    schema = T.StructType(
        [
            T.StructField("seq", key_type),
            T.StructField("expert", T.IntegerType()),
            T.StructField("score_sum", T.DoubleType()),
            T.StructField("picks", T.LongType()),
            T.StructField("n", T.LongType()),
        ]
    )
    rows = df.select(F.col(seq).alias("seq") if seq else F.lit(0).cast("long").alias("seq"), F.col(scores).alias("scores"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            p = softmax_matrix(batch.column(1))
            idx, _ = _top_k(p, k)
            codes = batch.column(0).dictionary_encode()
            group, keys = np.asarray(codes.indices), codes.dictionary
            g, e = len(keys), p.shape[1]
            sums = np.zeros((g, e))
            np.add.at(sums, group, p)
            picks = np.zeros((g, e), dtype=np.int64)
            np.add.at(picks, (np.repeat(group, idx.shape[1]), idx.ravel()), 1)
            n = np.bincount(group, minlength=g)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(np.repeat(np.arange(g), e))),
                    pa.array(np.tile(np.arange(e, dtype=np.int32), g)),
                    pa.array(sums.ravel()),
                    pa.array(picks.ravel()),
                    pa.array(np.repeat(n, e).astype(np.int64)),
                ],
                names=["seq", "expert", "score_sum", "picks", "n"],
            )

    parts = rows.mapInArrow(partial, schema)
    return parts.groupBy("seq", "expert").agg(
        F.sum("score_sum").alias("score_sum"), F.sum("picks").alias("picks"), F.sum("n").alias("n")
    )


def load_balance(df: DataFrame, scores: str, k: int, alpha: float, seq: str | None = None) -> DataFrame:
    """AGG-18: alpha * sum over experts of mean score * E * share of picks; with ``seq`` averaged over sequences."""
    sums = _expert_sums(df, scores, k, seq)
    per_seq = sums.groupBy("seq").agg(
        (
            F.sum((F.col("score_sum") / F.col("n")) * (F.col("picks") / (F.col("n") * k)))
            * F.count(F.lit(1))
            * F.lit(alpha)
        ).alias("loss")
    )
    return per_seq.agg(F.avg("loss").alias("aux_loss"))


def tokens_per_expert(routes: DataFrame, experts: str = "route.experts") -> DataFrame:
    """AGG-19: picks per expert and the running end offsets (one row per expert)."""
    counts = routes.select(F.explode(experts).alias("expert")).groupBy("expert").agg(F.count(F.lit(1)).alias("n_tokens"))
    w = Window.orderBy("expert").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("end_offset", F.sum("n_tokens").over(w))


def group_mean_pool(df: DataFrame, vector: str, groups: int, target: int, out: str = "pooled") -> DataFrame:
    """AGG-16: vectors of ``groups`` heads, neighbours averaged down to ``target`` heads (unchanged if not above it)."""
    if groups <= target:
        return df.withColumn(out, F.col(vector).cast("array<double>"))
    if groups % target:
        raise ValueError(f"{groups} heads cannot be merged evenly into {target}")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def pool(col: pa.Array) -> pa.Array:
        x, off = flat_doubles(col)
        n, width = len(off) - 1, (off[1] - off[0] if len(off) > 1 else 0)
        if n and (not (np.diff(off) == width).all() or width % groups):
            raise ValueError("vectors must have equal length divisible by the number of heads")
        m = x.reshape(n, target, groups // target, width // groups).mean(axis=2).reshape(n, -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    return df.withColumn(out, pool(F.col(vector)))


def upsert_params(base: DataFrame, updates: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """JOIN-02: values replaced where the key has an update; keys only in the updates are ignored.

    For parameters in long form the key is (name, element), which also spreads a large parameter over the tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    new = updates.select(*keys, F.struct(F.col(value).alias("v")).alias("_new"))
    return base.join(new, keys, "left").withColumn(
        value, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(value))
    ).drop("_new")


def score_loss(df: DataFrame, kind: str, score: Column, target: Column, by: list[str] | None = None) -> DataFrame:
    """AGG-21: mean of squared error ("regression"), cross-entropy ("single_label": score is an array, target a class)
    or binary cross-entropy with logits ("multi_label": score and target numbers)."""
    if kind == "regression":
        loss = F.pow(score - target, F.lit(2))
    elif kind == "single_label":
        loss = token_nll(score, target.cast("int"))
    elif kind == "multi_label":
        loss = F.greatest(score, F.lit(0.0)) - score * target + F.log1p(F.exp(-F.abs(score)))
    else:
        raise ValueError("kind must be regression, single_label or multi_label")
    rows = df.select(*(by or []), loss.alias("_loss"))
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(F.avg("_loss").alias("loss"))


def max_abs_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """AGG-23: largest absolute difference over all keys (missing on one side counts as a mismatch) and the verdict."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    out = joined.agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
    )
    return out.withColumn("equal", (F.coalesce("max_diff", F.lit(0.0)) < tolerance) & (F.col("unmatched") == 0))
