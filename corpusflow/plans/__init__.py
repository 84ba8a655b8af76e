"""Registered queries by inventory name."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.render import Renderer
from corpusflow.functions.templates import get_template
from corpusflow.functions.tokenizers import whitespace
from corpusflow.operators.align import valid_sft
from corpusflow.plans import q_corpus, q_examples, q_scores, q_streams  # noqa: F401
from corpusflow.plans.catalog import CHAT_SQL, QUERIES, SQL, aligned_chats, query

_WHOLE = """,
    r AS (SELECT conv_id, string_agg(
        CASE WHEN i = 0 AND system <> '' THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) WHEN i > 0 AND i % 2 = 0 THEN chr(10) ELSE '' END
        || CASE WHEN i % 2 = 0 THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text || '</s>' END, '' ORDER BY i) AS t
      FROM msg GROUP BY conv_id)
    SELECT conv_id, t AS text, length(t) AS n_chars, len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS n_tokens FROM r
"""


@query("TPL-01:conversation", "WITH " + CHAT_SQL + _WHOLE)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns assembled, aligned, filtered and rendered: one text per conversation with its length."""
    chat = valid_sft(aligned_chats(spark, sf_dir))
    texts = Renderer(get_template("chatml"), "<s>", "</s>").text(F.concat("prompt", "response"), F.col("system"), None)
    whole = chat.select("conv_id", F.array_join(texts, "").alias("text"))
    return whole.select("conv_id", "text", F.length("text").alias("n_chars"), F.size(whitespace(F.col("text"))).alias("n_tokens"))


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
