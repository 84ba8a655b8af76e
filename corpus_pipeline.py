"""Corpus pipeline: stages that each take what the one before kept, written in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.bpe import definition, encoded
from corpusflow.llm.decontaminate import without_contaminated
from corpusflow.llm.line_dedup import deduplicated
from corpusflow.llm.near_dedup import near_duplicates
from corpusflow.llm.quality import fit, scored
from corpusflow.llm.queries import QUALITY_THRESHOLD, held_out_of_quality, tokenizer_path
from corpusflow.llm.tables import broadcast_if_small, original, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; it learns from labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out_of_quality())
    return original(scored(docs, fit(docs, labels)).where(F.col("score") >= QUALITY_THRESHOLD), docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every long line at its first place only, and n_chars of the texts as they are then.

    A document goes only if it lost lines and nothing but white space is left of it.
    """
    found = deduplicated(docs).where(r"n_removed = 0 OR clean RLIKE '\\S'")
    texts = {"text": F.col("clean"), "n_chars": F.when(F.col("n_removed") > 0, F.length("clean"))}

    def value(i: int, name: str):
        own = F.col(f"c{i}")
        if name == "n_chars":
            return F.coalesce(texts[name].cast(docs.schema[name].dataType), own).alias(name)
        return texts.get(name, own).alias(name)

    return found.select(*[value(i, name) for i, name in enumerate(docs.columns)])


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), and one row of it.

    Documents go by doc_id.  If rows share one or have none, every row gets a number of its own instead: different texts
    are different documents whatever their ids, and of repeated rows with words one stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, key, text = docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    if rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count():
        rows, key = written(rows.withColumn("number", F.monotonically_increasing_id()), "numbered"), "number"
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), shingle=5, percent=80)
    gone = written(found.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    kept = rows.join(broadcast_if_small(gone, 1_000_000), F.col(key) == F.col("gone"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words stand in benchmark passages."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their whole texts."""
    return original(encoded(docs, definition(tokenizer_path())), docs, "tokens")


STAGES = [
    ("quality", good_quality),
    ("line_dedup", lines_once),
    ("near_dedup", one_per_group),
    ("decontamination", clean_of_benchmark),
    ("bpe", token_ids),
]

# A fitted model, edit distances over all lines and library tokenisation have no SQL form; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
