"""Sinks: plans as JSON, loss and growth logs, metric files, speed tables, examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decimals each metric is printed with (None: whole number).
METRIC_DECIMALS = {
    "ppl": 4,
    "throughput_tok_per_s": 2,
    "elapsed_s": 2,
    "model_mem_mib": 1,
    "peak_mem_mib": 1,
    "kv_cache_mem_mib": 1,
    "num_eval_tokens": 0,
}


def write_plan_json(plans: DataFrame, path: str, by: Sequence[str] = ("run_id",)) -> None:
    """SNK-01: one folder per run with its reserved list and mapping (see ``selection.plan_json``)."""
    for kind in ("reserved_layers", "layer_mapping"):
        plans.select(*by, F.col(kind).alias("value")).write.partitionBy(*by).mode("errorifexists").text(f"{path}/{kind}")


def loss_lines(tokens: DataFrame, nll: str = "nll") -> DataFrame:
    return tokens.withColumn("value", F.col(nll).cast("string"))


def growth_rows(tokens: DataFrame, bytes_col: str, pos: str = "pos", every: int = 1000) -> DataFrame:
    """SNK-02: every ``every``-th token with the cache size in MiB to 2 decimals."""
    return tokens.where((F.col(pos) + 1) % every == 0).select(
        *[c for c in tokens.columns if c not in (bytes_col, pos)],
        (F.col(pos) + 1).alias("token"),
        F.round(F.col(bytes_col) / F.lit(1024.0**2), 2).alias("allocated_mib"),
    )


def write_loss_log(tokens: DataFrame, path: str, order: Sequence[str], nll: str = "nll") -> None:
    """SNK-02: one loss per line; files in range order, so together they are in order."""
    parts = tokens.repartitionByRange(*order).sortWithinPartitions(*order)
    parts.select(F.col(nll).cast("string").alias("value")).write.mode("errorifexists").text(path)


def write_growth_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, header=True)


def metric_lines(metrics: DataFrame, metric: str = "metric", value: str = "value") -> Column:
    """SNK-03: ``key=value`` with the decimals of the key."""
    text = F.col(value).cast("string")
    for key, digits in METRIC_DECIMALS.items():
        text = F.when(F.col(metric) == key, F.format_string(f"%.{digits}f", F.col(value))).otherwise(text)
    return F.concat(F.col(metric), F.lit("="), text)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-03: the few lines of a run's metric file."""
    metrics.select(metric_lines(metrics).alias("value")).repartition(1).write.mode("errorifexists").text(path)


def write_speed_csv(rows: DataFrame, path: str) -> None:
    """SNK-04: one small csv file with header."""
    rows.repartition(1).write.mode("errorifexists").csv(path, header=True)


def to_markdown(rows: DataFrame, limit: int = 1000) -> str:
    """SNK-04: a short result table as markdown, for display; more than ``limit`` rows are an error."""
    data = rows.limit(limit + 1).collect()
    if len(data) > limit:
        raise ValueError(f"more than {limit} rows are no table to print")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in data])


def write_examples(df: DataFrame, path: str) -> None:
    """SNK-05."""
    df.write.mode("errorifexists").parquet(path)
