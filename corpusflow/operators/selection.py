"""Choosing layers from score tables (run_id, target, layer, score) and the plans that follow.

A run has as many rows as its model has layers; work is grouped by run, so many runs are handled at once.
A missing row or NULL stands for minus infinity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def _score() -> Column:
    return F.coalesce(F.col("score"), F.lit(NEG_INF))


def select_drop(similarity: DataFrame, n: int, by: Sequence[str] = ("run_id", "target")) -> DataFrame:
    """TOP-01: the n best-scored layers of each run."""
    w = Window.partitionBy(*by).orderBy(_score().desc(), "layer")
    return similarity.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def joint_scores(attn: DataFrame, mlp: DataFrame, n_layers: int) -> DataFrame:
    """TOP-02: both score sets of a run as one, the second numbered after the first."""
    return attn.select("run_id", "layer", "score").unionByName(
        mlp.select("run_id", (F.col("layer") + n_layers).alias("layer"), "score")
    )


def select_drop_joint(attn: DataFrame, mlp: DataFrame, n: int, n_layers: int) -> DataFrame:
    return select_drop(joint_scores(attn, mlp, n_layers), n, by=["run_id"])


def select_block(matrix: DataFrame, n: int, gap_column: str = "reference") -> DataFrame:
    """TOP-03: (run_id, layer) of the n consecutive layers whose removal changes the state least.

    The reference reads column n of a matrix that keeps gap g in column g - 1, i.e. gap n + 1; ``exact`` reads gap n.
    """
    if gap_column not in ("reference", "exact"):
        raise ValueError("gap_column must be reference or exact")
    gap = n + 1 if gap_column == "reference" else n
    best = (
        matrix.where(F.col("gap") == gap)
        .groupBy("run_id")
        .agg(F.max_by("layer", F.struct(_score(), -F.col("layer"))).alias("begin"), F.max("score").alias("score"))
    )
    return best.select("run_id", "score", F.explode(F.expr(f"sequence(begin, begin + {n - 1})")).alias("layer"))


def argmax_with_tolerance(scores: DataFrame, tol: float, by: Sequence[str] = ("run_id", "target")) -> DataFrame:
    """TOP-04: the first layer whose score is within ``tol`` of the run's maximum."""
    best = F.max(_score()).over(Window.partitionBy(*by))
    close = scores.withColumn("best", best).where(F.abs(_score() - F.col("best")) < tol)
    return close.groupBy(*by).agg(F.max("best").alias("score"), F.min("layer").alias("layer"))


def greedy_top_k(scores: DataFrame, k: int, tol: float, by: Sequence[str] = ("run_id", "target")) -> DataFrame:
    """TOP-05: k rounds of TOP-04, each picked score set to 0 (so it can be picked again among negative ones)."""
    arr = scores.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("layer", _score().alias("s")))).alias("_items")
    )
    arr = arr.select(
        *by, F.transform("_items", lambda x: x["layer"]).alias("_ids"), F.transform("_items", lambda x: x["s"]).alias("_s")
    )
    start = F.struct(F.col("_s").alias("s"), F.array().cast("array<struct<layer:int,score:double>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        top = F.array_max(acc["s"])
        at = F.array_position(F.transform(acc["s"], lambda v: F.abs(v - top) < tol), F.lit(True)).cast("int")
        picked = F.struct(F.get(F.col("_ids"), at - 1).cast("int").alias("layer"), top.alias("score"))
        return F.struct(
            F.transform(acc["s"], lambda v, i: F.when(i == at - 1, F.lit(0.0)).otherwise(v)).alias("s"),
            F.concat(acc["out"], F.array(picked)).cast("array<struct<layer:int,score:double>>").alias("out"),
        )

    folded = arr.select(*by, F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["out"].alias("_out"))
    return folded.select(*by, F.posexplode("_out").alias("round", "p")).select(*by, "round", "p.layer", "p.score")


def iterative_drop(
    score: Callable[[DataFrame | None], DataFrame], n_per_epoch: int, epochs: int, by: Sequence[str] = ("run_id", "target")
) -> DataFrame:
    """TOP-06: each epoch scores the layers left (``score(dropped)``) and drops the best n; all runs advance together.

    The picks of an epoch are written before the next one starts, so plans stay short.
    """
    from corpusflow.session import written

    dropped: DataFrame | None = None
    for epoch in range(epochs):
        scores = score(dropped)
        if dropped is not None:
            scores = scores.join(dropped.select(*by, "layer"), [*by, "layer"], "left_anti")
        picks = select_drop(scores, n_per_epoch, by).select(*by, "layer", "score", F.lit(epoch + 1).alias("epoch"), "rank")
        dropped = written(picks if dropped is None else dropped.unionByName(picks), "dropped")
    return dropped


def complement(all_ids: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN-03: ids that were not chosen."""
    return all_ids.join(chosen.select(*keys).distinct(), list(keys), "left_anti")


def split_joint(df: DataFrame, n_layers: int, layer: str = "layer") -> DataFrame:
    """SET-01: joint ids back to (module, layer)."""
    is_mlp = F.col(layer) >= n_layers
    return df.withColumn("module", F.when(is_mlp, "mlp").otherwise("attn")).withColumn(
        layer, F.when(is_mlp, F.col(layer) - n_layers).otherwise(F.col(layer))
    )


def merge_drop_lists(previous: DataFrame, new: DataFrame, keys: Sequence[str] = ("run_id", "layer")) -> DataFrame:
    """SET-02: earlier and new picks together."""
    return previous.select(*keys).unionByName(new.select(*keys)).distinct()


def normalise_drop_list(raw: Column, n_layers: Column | int, indices: bool) -> Column:
    """SET-03: NULL -> all false; index list or (padded, cut) boolean list -> booleans of length ``n_layers``."""
    n = F.lit(n_layers) if isinstance(n_layers, int) else n_layers
    slots = F.sequence(F.lit(0), n - 1)
    if indices:
        return F.transform(slots, lambda i: F.coalesce(F.array_contains(raw, i), F.lit(False)))
    return F.transform(slots, lambda i: F.coalesce(F.get(raw, i), F.lit(False)))


def reindex_layers(reserved: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """SET-04: old layer -> dense new number."""
    w = Window.partitionBy(*by).orderBy("layer")
    return reserved.withColumn("new_layer", F.row_number().over(w) - 1)


def active_slots(plan: DataFrame, by: Sequence[str] = ("run_id",), drop: str = "drop_attn") -> DataFrame:
    """SET-05: dense slot of each layer that keeps its attention, and their number."""
    kept = plan.where(~F.col(drop))
    w = Window.partitionBy(*by)
    return kept.withColumn("slot", F.row_number().over(w.orderBy("layer")) - 1).withColumn(
        "n_slots", F.count(F.lit(1)).over(w)
    )


def plan_json(reserved: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """SNK-01: per run the sorted list of reserved layers and the old -> new mapping, both as JSON text."""
    numbered = reindex_layers(reserved, by)
    grouped = numbered.groupBy(*by).agg(
        F.array_sort(F.collect_list("layer")).alias("_ids"),
        F.array_sort(F.collect_list(F.struct("layer", "new_layer"))).alias("_pairs"),
    )
    mapping = F.map_from_entries(
        F.transform("_pairs", lambda p: F.struct(p["layer"].cast("string").alias("k"), p["new_layer"].alias("v")))
    )
    return grouped.select(*by, F.to_json("_ids").alias("reserved_layers"), F.to_json(mapping).alias("layer_mapping"))
