"""Registered queries of this package: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm import oracles
from corpusflow.llm.bpe import definition, encoded
from corpusflow.llm.centroids import centroid_digest, clustered
from corpusflow.llm.chat import ChatTemplate, format_conversations, read_turns, unescape
from corpusflow.llm.decontaminate import contaminated
from corpusflow.llm.fingerprints import fingerprints, likeness
from corpusflow.llm.html_text import extracted
from corpusflow.llm.importance import importance
from corpusflow.llm.line_dedup import deduplicated
from corpusflow.llm.near_dedup import near_duplicates
from corpusflow.llm.neighbours import with_next
from corpusflow.llm.ppm import scores
from corpusflow.llm.quality import AttentionModel, fit, scored
from corpusflow.llm.tables import annotate, table
from corpusflow.llm.token_files import read_tokens, write_tokens
from corpusflow.llm.warc import capture_history
from corpusflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op9_near_dedup", oracles.NEAR_DEDUP)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of at least 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op8_decontamination", oracles.DECONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a passage of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("c0").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op4_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its text with the second half taken from the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = annotate(docs, "text", lambda column: [pa.array(fingerprints(column), pa.binary())], {"mark": T.BinaryType()})
    marked = marked.select(F.col("c0").alias("doc_id"), F.col("c1").alias("text"), "mark")
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )

    def compared(rows: pa.RecordBatch, after: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in rows.column("text").to_pylist()]
        others = [t or "" for t in after.column("text").to_pylist()]
        edited = [t[: len(t) - len(t) // 2] + o[: len(t) // 2] for t, o in zip(texts, others, strict=True)]
        own, near = rows.column("mark").to_pylist(), after.column("mark").to_pylist()
        new = fingerprints(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([m.hex() for m in own], pa.string()),
                pa.array([m.hex() for m in new], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, near, strict=True)], pa.float64()),
            ],
            schema.names,
        )

    return with_next(marked, "doc_id", schema, compared)


@query("op6_chat_formatting", oracles.CHAT)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, then turns and trained texts read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    chats = format_conversations(turns.union(extra)).select("conv_id", "formatted", "segments")
    back = chats.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], ChatTemplate())).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    digest = lambda c: F.sha2(F.array_join(c, "").cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(lines).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        digest("loss").alias("loss_sha256"),
        "formatted_chars",
    )


def tokenizer_path() -> str:
    """The tokenizer file that the BPE query takes; installed on the machine that makes the query, not needed elsewhere."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    tokenizer = definition(tokenizer_path())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, tokenizer, back=True).select(
        F.col("c0").alias("doc_id"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op1_ppm")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document under a byte model of four fifths of them, beside a count model of tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


@query("op3_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extracted(pages).select(F.col("c0").alias("page_id"), F.col("c1").alias("url"), F.col("main_text").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def held_out_of_quality() -> Column:
    """Documents whose labels the quality model may not see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


QUALITY_THRESHOLD = 0.3


def quality_model(spark: SparkSession, sf_dir: str) -> AttentionModel:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out_of_quality())
    return fit(table(spark, sf_dir, "documents"), labels)


@query("op7_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a model of the labelled ones outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, quality_model(spark, sf_dir)).select(F.col("c0").alias("doc_id"), "score")
    return found.select(
        "doc_id",
        F.coalesce(held_out_of_quality(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@query("op10_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that stood, within two edits or more for long lines, in an earlier document or line."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("c0").alias("doc_id"), "n_lines", "n_removed", F.coalesce("clean", F.lit("")).alias("text"))


@query("op2_warc", oracles.WARC)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives, read back and merged into one capture history; a page is captured at its number's second."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captured = F.lit(1_700_000_000) + F.coalesce(F.col("page_id"), F.lit(0))
    history = capture_history(pages.withColumn("captured", captured))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


END_OF_DOCUMENT = 2


@query("op11_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written as Parquet lists in the order of doc_id, and their place and checksum read back."""
    path = scratch_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_tokens(docs, path, definition(tokenizer_path()), END_OF_DOCUMENT)
    back = read_tokens(spark, path)

    def checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("tokens")
            at, flat = [4 * x for x in ids.offsets.to_pylist()], memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], schema.names)

    schema = T.StructType([*back.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])
    return back.mapInArrow(checksums, schema)


@query("op12_centroids", oracles.CENTROIDS)
def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of eight centroids of every embedding after ten rounds."""
    found, centroids = clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024)
    sums = [(r["cluster"], r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()]  # one row per centroid
    rows = [(c, s, centroid_digest(centroids[c])) for c, s in sums]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(sum(s for _, s in sums)).cast("long").alias("inertia"), "centroid_sha256"
    )


@query("op13_importance", oracles.IMPORTANCE)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document towards the benchmark, and the rank of the tenth that is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance(docs, table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed=2024, percent=10, least_words=20)
    return found.select(F.col("c0").alias("doc_id"), "n_features", "weight", "score", "rank")
