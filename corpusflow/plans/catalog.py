"""Registry of the runnable queries and the SQL that checks them, plus inputs derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.align import align, assemble_turns
from corpusflow.session import spread
from corpusflow.sources.registry import DatasetSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name, with the SQL that gives the same rows."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Document texts for CPU-heavy work, spread over the cores when the table has few splits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    return spread(docs, "doc_id")


# Chats of the driver tables already use canonical role names.
CHAT = DatasetSpec(name="conversations", formatting="sharegpt", user_tag="user", assistant_tag="assistant")
INSTRUCTIONS = DatasetSpec(name="instructions")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one row each."""
    return assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def aligned_chats(spark: SparkSession, sf_dir: str, mode: str = "drop") -> DataFrame:
    return align(chats(spark, sf_dir), CHAT, keep=["conv_id"], mode=mode)


def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: document text, its language as input, its quality label as output."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("instruction"), F.col("lang").alias("input"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("output"))
    return docs.join(labels, "doc_id")


def ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking data: two answers per instruction, one earlier round as history."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("instruction"), F.col("lang").alias("input"))
    labels = table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    return rows.select(
        "doc_id",
        "instruction",
        "input",
        F.array(F.concat(F.lit("good "), F.col("quality").cast("string")), F.concat(F.lit("bad "), F.col("toxic").cast("string"))).alias("output"),
        F.array(F.array(F.lit("hello"), F.col("input"))).alias("history"),
    )


N_LAYERS = 8


def layer_states(spark: SparkSession, sf_dir: str, layers: int = N_LAYERS) -> DataFrame:
    """Hidden states from the embedding table: token v of sample floor(sqrt(v)) enters layer l as vector v + 7 l.

    Samples get unequal lengths (2 s + 1 tokens), every vector is used.
    """
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = emb.agg(F.count(F.lit(1))).scalar()
    sample = F.floor(F.sqrt(F.col("vec_id").cast("double")))
    grid = emb.select("vec_id", sample.alias("sample_id")).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    grid = grid.select(
        F.concat(F.lit("run"), (F.col("sample_id") % 3).cast("string")).alias("run_id"),
        F.lit("attn").alias("target"),
        "layer",
        "sample_id",
        (F.col("vec_id") - F.col("sample_id") * F.col("sample_id")).alias("token_pos"),
        ((F.col("vec_id") + 7 * F.col("layer")) % n).alias("_in"),
        ((F.col("vec_id") + 7 * (F.col("layer") + 1)) % n).alias("_out"),
    )
    h_in = emb.select(F.col("vec_id").alias("_in"), F.col("embedding").alias("h_in"))
    h_out = emb.select(F.col("vec_id").alias("_out"), F.col("embedding").alias("h_out"))
    return grid.join(h_in, "_in").join(h_out, "_out").drop("_in", "_out")


# SQL fragments ---------------------------------------------------------------------------------------------------

# Messages of aligned conversations: conv_id, i, n, role, text, system.
CHAT_SQL = """
sys AS (SELECT conv_id, min_by(role, turn) = 'system' AS has_sys,
               CASE WHEN min_by(role, turn) = 'system' THEN min_by(text, turn) ELSE '' END AS system
        FROM conversations GROUP BY conv_id),
numbered AS (SELECT c.conv_id, c.role, c.text, s.system,
                    row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1 - CAST(has_sys AS INT) AS i,
                    count(*) OVER (PARTITION BY c.conv_id) - CAST(has_sys AS INT) AS n0
             FROM conversations c JOIN sys s USING (conv_id)),
even AS (SELECT conv_id, role, text, system, i, n0 - n0 % 2 AS n FROM numbered WHERE i >= 0 AND i < n0 - n0 % 2),
bad AS (SELECT DISTINCT conv_id FROM even
        WHERE (i % 2 = 0 AND role NOT IN ('user', 'observation')) OR (i % 2 = 1 AND role NOT IN ('assistant', 'function_call'))),
msg AS (SELECT * FROM even WHERE conv_id NOT IN (SELECT conv_id FROM bad))
"""


def tokens_sql(column: str) -> str:
    """Whitespace tokens."""
    return f"list_filter(string_split_regex({column}, '\\s+'), lambda x: x <> '')"


STATES_SQL = f"""
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER () AS n FROM embeddings),
grid AS (SELECT 'run' || CAST(CAST(floor(sqrt(CAST(vec_id AS DOUBLE))) AS BIGINT) % 3 AS VARCHAR) AS run_id,
                CAST(floor(sqrt(CAST(vec_id AS DOUBLE))) AS BIGINT) AS sample_id,
                vec_id, layer, (vec_id + 7 * layer) % n AS a, (vec_id + 7 * (layer + 1)) % n AS b
         FROM emb, range(0, {N_LAYERS}) t(layer)),
states AS (SELECT g.run_id, g.sample_id, g.vec_id, CAST(g.layer AS INT) AS layer, x.v AS h_in, y.v AS h_out
           FROM grid g JOIN emb x ON x.vec_id = g.a JOIN emb y ON y.vec_id = g.b)
"""

# Mean over samples of mean cosine of whole-layer input and output.
BLOCK_SQL = (
    STATES_SQL
    + """,
per_sample AS (SELECT run_id, layer, sample_id, avg(list_cosine_similarity(h_in, h_out)) AS m FROM states GROUP BY ALL),
sim AS (SELECT run_id, layer, avg(m) AS score FROM per_sample GROUP BY ALL)
"""
)

# Mean over samples of mean cosine of x and x + f.
RESIDUAL_SQL = (
    STATES_SQL
    + """,
res AS (SELECT run_id, layer, sample_id, h_in, list_transform(list_zip(h_in, h_out), lambda z: z[1] + z[2]) AS h FROM states),
per_sample_r AS (SELECT run_id, layer, sample_id, avg(list_cosine_similarity(h_in, h)) AS m FROM res GROUP BY ALL),
rsim AS (SELECT run_id, layer, avg(m) AS score FROM per_sample_r GROUP BY ALL)
"""
)
