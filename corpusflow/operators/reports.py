"""Run metrics: memory, throughput, sparsity, progress and comparisons between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ordering import exact_median, running_totals
from corpusflow.session import written

MIB = 1024.0 * 1024.0


def experiment_grid(
    models: DataFrame, modules: Sequence[str], counts: Sequence[int], tasks: Sequence[str], shots: Sequence[int]
) -> DataFrame:
    """JOIN-07: every model with every module and count, and each (task, n_shot) pair taken together.

    The settings are literal lists expanded per model row, so nothing is joined.
    """
    if len(tasks) != len(shots):
        raise ValueError("tasks and shots are paired and must have the same length")
    pairs = F.arrays_zip(
        F.array(*[F.lit(t) for t in tasks]).alias("task"), F.array(*[F.lit(s) for s in shots]).alias("n_shot")
    )
    return (
        models.withColumn("module", F.explode(F.array(*[F.lit(m) for m in modules])))
        .withColumn("drop_n", F.explode(F.array(*[F.lit(c) for c in counts])))
        .withColumn("_p", F.explode(pairs))
        .select("*", "_p.*")
        .drop("_p")
    )


def compare_runs(metrics: DataFrame, run_a: str, run_b: str, by: Sequence[str] = ()) -> DataFrame:
    """JOIN-08: (run_id, metric, value) rows as one line per metric; a metric of one run only keeps NULL for the other."""
    return (
        metrics.where(F.col("run_id").isin(run_a, run_b))
        .groupBy(*by, "metric")
        .pivot("run_id", [run_a, run_b])
        .agg(F.first("value"))
        .withColumnsRenamed({run_a: "value_a", run_b: "value_b"})
    )


def kv_footprint(plan: DataFrame, by: Sequence[str], heads: Column, dim: Column, tokens: Column, width: int = 2) -> DataFrame:
    """AGG-07: key and value bytes of the layers that keep attention; MiB = bytes / 1024^2."""
    size = F.when(F.col("drop_attn"), F.lit(0)).otherwise(2 * heads.cast("long") * dim * tokens * width)
    return plan.groupBy(*by).agg(
        F.count_if(~F.col("drop_attn")).alias("active_layers"),
        F.sum(size).alias("bytes"),
        (F.sum(size) / MIB).alias("mib"),
    )


def throughput(df: DataFrame, by: Sequence[str], tokens: str, seconds: str) -> DataFrame:
    """AGG-08: total tokens per total time, and tokens per mean time of a run."""
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(tokens), F.sum(seconds)).alias("tokens_per_s"),
        F.try_divide(F.max(tokens), F.avg(seconds)).alias("decode_per_s"),
    )


def speed_summary(
    steps: DataFrame, by: Sequence[str], seconds: str, phase: str, prefill_len: Column, batch: int, oom: Column | None = None
) -> DataFrame:
    """AGG-09: prefill = length / time * batch, decode = batch / median step time, both to 2 decimals.

    A group with an out-of-memory row reports the text OOM instead.  Durations are usually derived, so the few columns
    needed are written once before they are read three times.
    """
    failed = F.lit(False) if oom is None else oom
    steps = written(steps.select(*by, seconds, phase, prefill_len.alias("_len"), failed.alias("_oom")), "steps")
    base = steps.groupBy(*by).agg(
        F.max(F.when(F.col(phase) == "prefill", F.col(seconds))).alias("_prefill"),
        F.max("_len").alias("_len"),
        F.max("_oom").alias("_oom"),
    )
    median = exact_median(steps.where(F.col(phase) == "decode"), by, seconds, "_median")
    joined = base.join(median, list(by), "left")

    def shown(value: Column) -> Column:
        return F.when(F.col("_oom"), "OOM").otherwise(F.round(value, 2).cast("string"))

    return joined.select(
        *by,
        shown(F.try_divide(F.col("_len"), F.col("_prefill")) * batch).alias("prefill_tokens_s"),
        shown(F.try_divide(F.lit(1.0), F.col("_median")) * batch).alias("decode_tokens_s"),
    )


def stop_after_oom(rows: DataFrame, by: Sequence[str], order: str, value: str = "prefill_tokens_s") -> DataFrame:
    """AGG-09: rows of a sweep up to and including its first OOM row."""
    first = rows.where(F.col(value) == "OOM").groupBy(*by).agg(F.min(order).alias("_stop"))
    joined = rows.join(first, list(by), "left")
    return joined.where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def average_runs(rows: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """AGG-10: mean of each measure over the runs of a configuration."""
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("runs"))


def peak_memory(log: DataFrame, by: Sequence[str], used: str, weights: DataFrame | None = None) -> DataFrame:
    """AGG-11: largest value; with ``weights`` (by, weights_mib) also what the cache takes beyond them."""
    peak = log.groupBy(*by).agg(F.max(used).alias("peak_mib"))
    if weights is None:
        return peak
    return peak.join(weights, list(by), "left").withColumn("cache_mib", F.col("peak_mib") - F.col("weights_mib"))


def mpdr(runs: DataFrame, keys: Sequence[str] = ("model", "window"), drop: str = "drop", ppl: str = "ppl", mem: str = "mem_mib") -> DataFrame:
    """AGG-12: (relative loss increase) / (relative memory saved) against the run of the same keys that drops nothing."""
    base = runs.where(F.col(drop) == 0).select(*keys, F.col(ppl).alias("_ppl0"), F.col(mem).alias("_mem0"))
    joined = runs.where(F.col(drop) > 0).join(base, list(keys), "left")
    d_ppl = F.try_divide(F.col(ppl) - F.col("_ppl0"), F.col("_ppl0"))
    d_mem = F.try_divide(F.col("_mem0") - F.col(mem), F.col("_mem0"))
    return joined.withColumn("mpdr", F.try_divide(d_ppl, d_mem)).drop("_ppl0", "_mem0")


def sparsity(params: DataFrame, layer: Column, value: str = "value") -> DataFrame:
    """AGG-13: share of zeros per layer and overall (layer NULL); parameters outside layers are left out."""
    rows = params.select(layer.alias("layer"), (F.col(value) == 0).alias("_zero")).where(F.col("layer").isNotNull())
    return rows.rollup("layer").agg(
        F.avg(F.col("_zero").cast("double")).alias("sparsity"), F.count(F.lit(1)).alias("n_params")
    )


def parameter_counts(params: DataFrame, by: Sequence[str], numel: Column, trainable: Column, four_bit: Column) -> DataFrame:
    """AGG-14: trainable and all parameters (4-bit ones count twice), and the share in percent with 4 decimals."""
    n = F.when(four_bit, numel * 2).otherwise(numel)
    out = params.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(trainable, n)), F.lit(0)).alias("trainable_params"), F.sum(n).alias("all_params")
    )
    return out.withColumn(
        "percent", F.round(F.try_divide(F.col("trainable_params") * 100.0, F.col("all_params").cast("double")), 4)
    )


def running_average(df: DataFrame, value: str, weight: str, by: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """AGG-15: last value, sum, count and weighted mean after each update."""
    rows = df.withColumn("_vn", F.col(value) * F.col(weight))
    totals = running_totals(rows, {"run_sum": "_vn", "run_count": weight}, by, order, chunk)
    return totals.drop("_vn").withColumn("run_avg", F.try_divide("run_sum", "run_count"))


def clock(seconds: Column) -> Column:
    """Whole seconds as ``[D day[s], ]H:MM:SS``."""
    s = F.floor(seconds).cast("long")
    days = F.floor(s / 86_400)
    day_text = F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.concat(days.cast("string"), F.lit(" days, ")))
    rest = s % 86_400
    return F.concat(
        day_text, F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    )


def progress(df: DataFrame, by: Sequence[str], cur: Column, max_steps: Column, elapsed: Column) -> DataFrame:
    """AGG-22: mean time per step, remaining time and percentage from aggregated steps and seconds per run."""
    out = df.groupBy(*by).agg(cur.alias("current_steps"), max_steps.alias("total_steps"), elapsed.alias("elapsed_s"))
    per_step = F.coalesce(F.try_divide("elapsed_s", "current_steps"), F.lit(0.0))
    out = out.withColumn("remaining_s", (F.col("total_steps") - F.col("current_steps")) * per_step)
    return out.withColumn(
        "percentage",
        F.coalesce(F.round(F.try_divide(F.col("current_steps"), F.col("total_steps").cast("double")) * 100, 2), F.lit(100.0)),
    ).select("*", clock(F.col("elapsed_s")).alias("elapsed_time"), clock(F.col("remaining_s")).alias("remaining_time"))
