"""Queries: Structured Streaming versions, checked against their batch results, and plug-ins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import plugins
from corpusflow.functions import render as R
from corpusflow.functions.templates import CONTENT, EOS, Template, get_template, register_template
from corpusflow.functions.tokenizers import plug_in, whitespace
from corpusflow.operators import align as A
from corpusflow.functions.tokenizers import to_ids
from corpusflow.operators.ordering import id_chunk, time_chunk
from corpusflow.operators.scoring import perplexity, score_arrays
from corpusflow.plans.catalog import CHAT_SQL, INSTRUCTIONS, SQL, aligned_chats, documents, query, table, tokens_sql
from corpusflow.plans.q_examples import BATCH_ROWS, BLOCK, CUTOFF, _encoding, _joined, doc_tokens, doc_vocab
from corpusflow.plans.q_scores import DAY, EVENTS_SQL, LOSS_SQL
from corpusflow.session import scratch_path, written
from corpusflow.streaming import streams as X

SALTS = 4


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table as a stream of its files (one file or a folder of them)."""
    schema = table(spark, sf, name).schema
    return X.stream_dataset(spark, f"{sf}/{name}.parque[t]", schema)


@query("STM-01", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def streamed(spark: SparkSession, sf: str) -> DataFrame:
    out = X.collect_stream(stream(spark, sf, "documents").select("lang", "text"), "documents")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "STM-02",
    "SELECT doc_id, text || chr(10) || lang AS content, lang AS answer, 'Human: ' || text || chr(10) || lang || chr(10) || 'Assistant: ' AS rendered, len(" + tokens_sql("text") + ") AS n FROM documents",
)
def stream_aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Row-wise mappers are the same column expressions on a stream."""
    docs = stream(spark, sf, "documents").select("doc_id", F.col("text").alias("instruction"), F.col("lang").alias("input"), F.col("lang").alias("output"))
    a = A.align(docs, INSTRUCTIONS, ["doc_id"])
    texts = R.Renderer(get_template("default"), "<s>", "</s>").text(F.col("prompt"), F.col("system"), None)
    rows = a.select("doc_id", F.col("prompt")[0]["content"].alias("content"), F.col("response")[0]["content"].alias("answer"), texts[0].alias("rendered"))
    out = X.collect_stream(rows, "aligned").drop("batch_id")
    return out.withColumn("n", F.size(whitespace(F.col("content"))) - 1)


@query("STM-02:encode", SQL["PRE-02"])
def stream_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that arrive as files, encoded with a frozen vocabulary: the rows of the batch query."""
    chat, enc = _encoding(spark, sf, "chatml")
    path = scratch_path(spark, "chats")
    chat.repartitionByRange(4, "conv_id").write.parquet(path)
    out = X.stream_encode(X.stream_dataset(spark, path, chat.schema, max_files=2), enc, ["conv_id"], CUTOFF)
    return _joined(out.withColumn("n", F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)), ["conv_id", "n"], ["input_ids", "labels"])


@query("STM-02:pack", SQL["PRE-01"])
def stream_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that arrive as files, packed over trigger borders: the blocks of the batch query."""
    docs = doc_tokens(spark, sf).withColumn("tokens", F.concat("tokens", F.array(F.lit("</s>"))))
    ids = to_ids(docs, "tokens", written(doc_vocab(spark, sf), "vocab"), "ids").select("doc_id", "ids")
    pack = lambda files, out: X.stream_pack(files, "ids", "doc_id", BLOCK, id_chunk("doc_id"), BATCH_ROWS, path=out)
    found = _arriving(spark, ids, pack)
    return found.select("batch", "block", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join("input_ids", ",")).alias("ids"))


def _arriving(spark: SparkSession, rows: DataFrame, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``run(stream of files, folder)`` each time a third of the rows has arrived, in any number of files: it goes on."""
    path, out = scratch_path(spark, "arriving"), scratch_path(spark, "arrived")
    for part in _thirds(rows):
        part.write.mode("append").parquet(path)
        found = run(X.stream_dataset(spark, path, rows.schema), out)
    return found


def _thirds(rows: DataFrame) -> list[DataFrame]:
    """Rows by doc_id in three runs of about equal size."""
    held = written(rows, "rows")
    low, high = held.agg(F.percentile_approx("doc_id", [1 / 3, 2 / 3])).first()[0] or (0, 0)
    return [held.where(F.col("doc_id") <= low), held.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)), held.where(F.col("doc_id") > high)]


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the number of their language (3: all but en, fr and de)."""
    lang = F.col("lang")
    number = F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).otherwise(3)
    return table(spark, sf, "documents").select("doc_id", number.alias("dataset_idx"))


LANGUAGE_SQL = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END"


@query(
    "MIX-02:stream",
    f"WITH r AS (SELECT doc_id, {LANGUAGE_SQL} AS d, row_number() OVER (PARTITION BY {LANGUAGE_SQL} ORDER BY doc_id) - 1 AS rn FROM documents) "
    "SELECT doc_id, d AS dataset_idx, rn * 4 + d AS slot FROM r WHERE rn < (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY d))",
)
def stream_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Four datasets dealt in turn while they arrive."""
    deal = lambda files, out: X.stream_interleave(files, "dataset_idx", 4, ["doc_id"], id_chunk("doc_id"), path=out)
    return _arriving(spark, _languages(spark, sf), deal).drop("batch_id")


@query(
    "MIX-04:stream",
    f"""
    WITH r AS (SELECT doc_id, {LANGUAGE_SQL} AS d, row_number() OVER (PARTITION BY {LANGUAGE_SQL} ORDER BY doc_id) - 1 AS rn FROM documents),
    u AS (SELECT i AS slot, ('0x' || substr(md5('42:' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM range(0, (SELECT count(*) FROM documents)) t(i)),
    s AS (SELECT slot, CASE WHEN u < 0.4 THEN 0 WHEN u < 0.7 THEN 1 WHEN u < 0.9 THEN 2 ELSE 3 END AS d FROM u),
    k AS (SELECT slot, d, row_number() OVER (PARTITION BY d ORDER BY slot) - 1 AS rn FROM s),
    e AS (SELECT min(slot) AS stop FROM k JOIN (SELECT d, count(*) AS n FROM r GROUP BY d) USING (d) WHERE rn = n - 1)
    SELECT doc_id, d AS dataset_idx, slot FROM k JOIN r USING (d, rn) WHERE slot <= (SELECT stop FROM e)
    """,
)
def stream_by_chance(spark: SparkSession, sf: str) -> DataFrame:
    """The same datasets drawn by probability while they arrive."""
    probs = [0.4, 0.3, 0.2, 0.1]
    draw = lambda files, out: X.stream_interleave(files, "dataset_idx", 4, ["doc_id"], id_chunk("doc_id"), probs=probs, path=out)
    return _arriving(spark, _languages(spark, sf), draw).drop("batch_id")


@query("STM-03", "WITH " + EVENTS_SQL + "SELECT user_id, event_id FROM ev WHERE n <= 24 OR pos < 4 OR pos >= n - 20")
def stream_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Final state of the salted streaming operator = the batch result."""
    ev = stream(spark, sf, "events").select("user_id", "event_id", "ts")
    order = ["ts", "event_id"]
    changes = X.collect_stream(X.stream_retain(ev, ["user_id"], order, F.xxhash64("event_id"), SALTS, 4, 20), "retained")
    return X.retained_view(changes, ["user_id"], order, 4, 20, time_chunk("ts", DAY)).select("user_id", "event_id")


@query(
    "STM-03:evicted",
    "WITH " + EVENTS_SQL + "SELECT user_id, event_id, CASE WHEN n <= 24 OR pos < 4 OR pos >= n - 20 THEN 'kept' ELSE 'evicted' END AS change FROM ev",
)
def stream_evicted(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once, kept or evicted; states of users without events for ten days are dropped on the way."""
    ev = stream(spark, sf, "events").select("user_id", "event_id", "ts")
    by, order, chunk = ["user_id"], ["ts", "event_id"], time_chunk("ts", DAY)
    retained = X.stream_retain(ev, by, order, F.xxhash64("event_id"), SALTS, 4, 20, ts="ts", delay="3650 days", idle_seconds=10 * DAY)
    changes = X.collect_stream(retained, "evicted")
    kept, gone = X.both_views(changes, by, order, 4, 20, chunk)
    of = lambda rows, change: rows.select("user_id", "event_id", F.lit(change).alias("change"))
    return of(kept, "kept").union(of(gone, "evicted"))


@query("STM-04", "WITH " + EVENTS_SQL + "SELECT user_id, event_id, pos FROM ev WHERE (pos + 1) % 10 = 0")
def stream_sampled(spark: SparkSession, sf: str) -> DataFrame:
    ev = stream(spark, sf, "events").select("user_id", "event_id", "ts")
    out = X.stream_sample_every(ev, ["user_id"], ["ts", "event_id"], 10, time_chunk("ts", DAY))
    return out.select("user_id", "event_id", "pos")


@query("STM-05", "WITH " + LOSS_SQL + "SELECT label, round(exp(avg(nll)), 6) AS ppl, count(*) AS num_eval_tokens FROM loss GROUP BY label")
def stream_ppl(spark: SparkSession, sf: str) -> DataFrame:
    from corpusflow.operators.vectors import token_nll

    losses = stream(spark, sf, "embeddings").select("label", token_nll("embedding", "label").alias("nll"))
    out = X.collect_stream(X.stream_perplexity(losses, ["label"], "nll"), "ppl", "update")
    newest = out.groupBy("label").agg(F.max_by(F.struct("nll_sum", "num_eval_tokens"), "batch_id").alias("s"))
    return newest.select("label", F.round(F.exp(F.col("s.nll_sum") / F.col("s.num_eval_tokens")), 6).alias("ppl"), "s.num_eval_tokens")


@query(
    "STM-06",
    "SELECT doc_id, rn // 256 * 256 + row_number() OVER (PARTITION BY rn // 256 ORDER BY md5('42:' || doc_id), doc_id) - 1 AS slot FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)",
)
def stream_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """Buffers of 256 records; the last, unfinished one goes out at the end."""
    return X.stream_shuffle(stream(spark, sf, "documents").select("doc_id"), "doc_id", 42, buffer=256).select("doc_id", "slot")


@query(
    "STM-07",
    """
    WITH w AS (SELECT (epoch_us(ts) // 3600000000) AS hour, max(value) AS peak, count(*) AS polls FROM events GROUP BY 1)
    SELECT hour, peak, polls FROM w WHERE (hour + 1) * 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)
    """,
)
def stream_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly peaks; an hour is final once the watermark (10 minutes behind) has passed its end."""
    peaks = X.stream_poll_windows(stream(spark, sf, "events"), "ts", "value", "1 hour", "10 minutes")
    out = X.collect_stream(peaks, "peaks")
    return out.select(F.floor(F.unix_seconds("window_start") / 3600).alias("hour"), "peak", "polls")


@query(
    "STM-08",
    "SELECT 0 AS dataset_idx, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 1, item_id, length(text) FROM benchmark",
)
def stream_concatenated(spark: SparkSession, sf: str) -> DataFrame:
    a = stream(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = stream(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return X.collect_stream(X.stream_union([a, b]), "union").select("dataset_idx", "id", F.length("text").alias("n"))


@query("STM-09", "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= 500 THEN 'test' ELSE 'train' END AS split FROM events")
def stream_split(spark: SparkSession, sf: str) -> DataFrame:
    ev = stream(spark, sf, "events").select("event_id", "ts")
    return X.stream_take_skip(ev, ["ts", "event_id"], 500, time_chunk("ts", DAY)).select("event_id", "split")


# Plug-ins ------------------------------------------------------------------------------------------------------------


@query("UDF-01", r"SELECT doc_id, i AS line_no, length(line) AS n FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''")
def lines(spark: SparkSession, sf: str) -> DataFrame:
    """A mapper that returns more rows than it got, and drops some."""

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.assign(line=frame["text"].str.split("\n")).explode("line", ignore_index=True)
        rows["line_no"] = rows.groupby("doc_id").cumcount()
        rows = rows[rows["line"] != ""]
        return pd.DataFrame({"doc_id": rows["doc_id"], "line_no": rows["line_no"], "n": rows["line"].str.len()})

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return plugins.map_batches(docs, split, "doc_id long, line_no long, n long")


@query("UDF-02", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS h FROM (SELECT doc_id, {tokens_sql('lower(text)')} AS t FROM documents)")
def plugged_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A lower-casing tokeniser loaded once per worker."""

    def load():
        import re

        pattern = re.compile(r"[^ \t\r\n\f]+")
        return lambda text: pattern.findall(text.lower())

    docs = table(spark, sf, "documents").select("doc_id", plug_in(load)(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("h"))


@query(
    "UDF-03",
    "WITH " + CHAT_SQL + ", r AS (SELECT conv_id, string_agg(CASE WHEN i = 0 AND system <> '' THEN system ELSE '' END || CASE WHEN i % 2 = 0 THEN 'Q: ' || text || chr(10) || 'A: ' ELSE text || '</s>' END, '' ORDER BY i) AS t FROM msg GROUP BY conv_id) SELECT conv_id, md5(t) AS h FROM r",
)
def own_template(spark: SparkSession, sf: str) -> DataFrame:
    t = register_template(Template("question_answer", user=("Q: {{content}}\nA: ",), assistant=(CONTENT, EOS)), overwrite=True)
    texts = R.Renderer(t, "<s>", "</s>").text(F.concat("prompt", "response"), F.col("system"), None)
    return aligned_chats(spark, sf).select("conv_id", F.md5(F.array_join(texts, "")).alias("h"))


@query(
    "UDF-04",
    f"SELECT doc_id, round(exp(avg(length(token) / 4.0)), 4) AS ppl, count(*) AS num_eval_tokens FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY doc_id",
)
def plugged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer whose loss is a quarter of the token's length."""
    docs = documents(spark, sf).select("doc_id", whitespace(F.col("text")).alias("tokens"))
    losses = score_arrays(docs, "doc_id", "tokens", lambda frame: frame["token"].str.len() / 4.0, segment=4096, overlap=16)
    return perplexity(losses, ["doc_id"]).select("doc_id", F.round("ppl", 4).alias("ppl"), "num_eval_tokens")

