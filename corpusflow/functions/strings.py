"""Small string functions (STR)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ordering import running_total


def append_eos(text: Column, eos: str) -> Column:
    """STR-F2."""
    return F.concat(text, F.lit(eos))


def layer_of(name: Column) -> Column:
    """STR-F4: layer number of a parameter name, NULL where the name has none."""
    return F.when(F.contains(name, F.lit("layers")), F.split_part(name, F.lit("."), F.lit(3)).try_cast("int"))


def join_corpus(
    df: DataFrame, text: str, by: Sequence[str], order: Sequence[str], chunk: Column, sep: str = "\n\n"
) -> DataFrame:
    """STR-F1: where each row's text lies in the joined corpus of its group.

    The joined text itself is never built (it would be one value of one task): each row gets ``start``/``end``
    character offsets and ``piece``, the text with the separator that precedes it; the pieces in order of ``start``
    are the corpus.
    """
    sized = df.withColumn("_len", F.length(text) + F.lit(len(sep)))
    placed = running_total(sized, "_len", by, order, chunk, "_from", exclusive=True)
    return placed.select(
        *df.columns,
        F.col("_from").alias("start"),
        (F.col("_from") + F.length(text)).alias("end"),
        F.when(F.col("_from") == 0, F.col(text)).otherwise(F.concat(F.lit(sep), F.col(text))).alias("piece"),
    )
