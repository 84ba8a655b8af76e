"""Queries: sources, sinks, alignment, filters, templates and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import render as R
from corpusflow.functions.strings import append_eos, join_corpus, layer_of
from corpusflow.functions.templates import FAMILY_TEMPLATES, PLAIN_FAMILIES, TEMPLATES, families_df, get_template, special_tokens, templates_df
from corpusflow.functions.tokenizers import whitespace
from corpusflow.operators import align as A
from corpusflow.operators.mixing import limit_per_dataset
from corpusflow.operators.ordering import id_chunk
from corpusflow.plans.catalog import (
    BLOCK_SQL,
    CHAT,
    CHAT_SQL,
    INSTRUCTIONS,
    aligned_chats,
    chats,
    documents,
    instruction_rows,
    layer_states,
    query,
    ranking_rows,
    table,
    tokens_sql,
)
from corpusflow.session import scratch_path
from corpusflow.sources import cache, readers, registry, sinks


# Sources -----------------------------------------------------------------------------------------------------------


@query(
    "SRC-01",
    """
    SELECT fmt, doc_id, md5(text) AS h FROM documents, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)
    UNION ALL
    SELECT 'text', -1, md5(line) FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    """,
)
def read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in four formats and read again through the extension dispatch."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    result = None
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, "docs")
        writer = docs.write
        if fmt == "csv":
            writer.csv(path, header=True, quote='"', escape='"', quoteAll=True)
        else:
            getattr(writer, fmt)(path)
        back = readers.read_dataset(spark, path, schema="doc_id long, text string")
        part = back.select(F.lit(fmt).alias("fmt"), "doc_id", F.md5("text").alias("h"))
        result = part if result is None else result.unionByName(part)
    path = scratch_path(spark, "docs")
    docs.select("text").write.text(path)
    lines = readers.read_dataset(spark, path)
    return result.unionByName(lines.select(F.lit("text").alias("fmt"), F.lit(-1).cast("long").alias("doc_id"), F.md5("text").alias("h")))


@query("SRC-02", "SELECT 'parquet' AS fmt, true AS homogeneous, count(DISTINCT source) AS folders FROM documents")
def homogeneous(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "by-source")
    table(spark, sf, "documents").repartition("source").write.partitionBy("source").parquet(path)
    fmt = readers.check_homogeneous(spark, path)
    files = readers.file_manifest(spark, path)
    return files.agg(
        F.lit(fmt).alias("fmt"),
        F.bool_and(F.col("fmt") == fmt).alias("homogeneous"),
        F.count_distinct(F.regexp_extract("path", "source=([^/]+)/", 1)).alias("folders"),
    )


@query(
    "SRC-03",
    """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing hash' WHEN l.toxic = 1 THEN 'mismatch' ELSE 'ok' END AS status,
           sha1(d.text) AS sha1
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)
def checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents have a registered hash, wrong on purpose for toxic ones."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    known = table(spark, sf, "labels").select("doc_id", "toxic").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    entries = known.select("doc_id", F.when(F.col("toxic") == 1, F.sha1(F.lit("x"))).otherwise(F.sha1(F.col("text").cast("binary"))).alias("file_sha1"))
    return readers.checksum_status(docs, entries, "doc_id").select("doc_id", "status", "sha1")


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """One registry document per supplier nation, its suppliers as entries of all four kinds."""
    s = table(spark, sf, "supplier")
    kind = F.col("s_suppkey") % 4
    entry = F.struct(
        F.when(kind == 0, F.concat("s_name", F.lit(".json"))).alias("file_name"),
        F.when(kind == 1, F.concat(F.lit("hub/"), "s_name")).alias("hf_hub_url"),
        F.when(kind.isin(1, 2), F.concat(F.lit("ms/"), "s_name")).alias("ms_hub_url"),
        F.when(kind == 3, F.concat("s_name", F.lit(".py"))).alias("script_url"),
        F.create_map(F.lit("prompt"), F.lit("text")).alias("columns"),
    )
    maps = s.select("s_nationkey", F.to_json(F.create_map(F.col("s_name"), entry)).alias("value"))
    return registry.registry_from_json(maps)


@query(
    "SRC-04",
    """
    SELECT s_name AS name,
           CASE s_suppkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'hf_hub' WHEN 2 THEN 'ms_hub' ELSE 'script' END AS load_from,
           CASE s_suppkey % 4 WHEN 0 THEN s_name || '.json' WHEN 1 THEN 'hub/' || s_name WHEN 2 THEN 'ms/' || s_name ELSE s_name || '.py' END AS location
    FROM supplier
    """,
)
def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _registry(spark, sf).select("name", "load_from", "location")


@query("SRC-05", "SELECT doc_id, text AS prompt, CAST(NULL AS VARCHAR) AS query, CAST(NULL AS VARCHAR) AS response FROM documents")
def mapped_columns(spark: SparkSession, sf: str) -> DataFrame:
    spec = registry.with_columns(registry.DatasetSpec(name="docs"), {"prompt": "text"})
    return registry.map_columns(table(spark, sf, "documents"), spec, ["doc_id"]).select("doc_id", "prompt", "query", "response")


@query("SRC-06", "SELECT conv_id, turn, role AS canonical FROM conversations")
def mapped_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", registry.map_tags(F.col("role"), CHAT).alias("canonical"))


@query("SRC-07", "SELECT doc_id, source, length(text) AS n FROM documents WHERE source = 'src3'")
def one_split(spark: SparkSession, sf: str) -> DataFrame:
    return readers.select_split(table(spark, sf, "documents"), "src3", "source").select("doc_id", "source", F.length("text").alias("n"))


@query(
    "SRC-08",
    "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10",
)
def limited(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return limit_per_dataset(docs, "source", "doc_id", 10, id_chunk("doc_id"))


@query("SRC-09", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def cache_twice(spark: SparkSession, sf: str) -> DataFrame:
    """The second call finds the first one's result and ignores its own definition."""
    path = scratch_path(spark, "cache")
    docs = table(spark, sf, "documents")
    cache.cached(spark, path, lambda: docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")))
    return cache.cached(spark, path, lambda: docs.limit(0))


@query("SRC-10", "WITH " + BLOCK_SQL + " SELECT run_id, layer, round(score, 6) AS score FROM sim")
def score_cache(spark: SparkSession, sf: str) -> DataFrame:
    from corpusflow.operators.similarity import block_similarity

    path = scratch_path(spark, "scores")
    sim = block_similarity(layer_states(spark, sf))
    result = None
    for run in ("run0", "run1", "run2"):
        part = cache.cached_scores(spark, path, run, lambda run=run: sim.where(F.col("run_id") == run).drop("target"))
        result = part if result is None else result.unionByName(part)
    return result.select("run_id", "layer", F.round("score", 6).alias("score"))


@query("SRC-11", "SELECT event_type AS source, 'm' || CAST(user_id AS VARCHAR) AS metric, round(value, 2) AS value FROM events")
def metric_file(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as metric files, one folder per event type."""
    path = scratch_path(spark, "metrics")
    ev = table(spark, sf, "events")
    ev.select("event_type", F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("="), F.col("value").cast("string")).alias("value")).write.partitionBy("event_type").text(path)
    rows = readers.read_kv_metrics(spark, path)
    return rows.select(F.regexp_extract("source", "event_type=([^/]+)/", 1).alias("source"), "metric", F.round("value", 2).alias("value"))


@query("SRC-12", "SELECT CAST(l_quantity AS DOUBLE) AS used, CAST(l_linenumber AS DOUBLE) AS free, l_quantity + l_linenumber AS total FROM lineitem")
def poll_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "polls")
    li = table(spark, sf, "lineitem")
    li.select(F.concat_ws(" , ", *[c.cast("string") for c in (F.col("l_quantity"), F.col("l_linenumber"), F.col("l_quantity") + F.col("l_linenumber"))]).alias("value")).write.text(path)
    return readers.read_perf_log(spark, path).select("used", "free", "total")


@query(
    "SRC-13",
    r"SELECT count(*) AS entries, count(*) FILTER (regexp_matches(text, '\S')) AS non_empty, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(sum(length(text)) / count(*), 6) AS avg_chars FROM documents",
)
def inspected(spark: SparkSession, sf: str) -> DataFrame:
    return readers.inspect(table(spark, sf, "documents"), "text").withColumn("avg_chars", F.round("avg_chars", 6))


@query("SRC-13:head", "SELECT doc_id, length(text) AS chars, substr(text, 1, 80) AS prefix FROM documents ORDER BY doc_id LIMIT 10")
def inspected_head(spark: SparkSession, sf: str) -> DataFrame:
    return readers.inspect_head(table(spark, sf, "documents"), "doc_id", "text")


# Sinks -------------------------------------------------------------------------------------------------------------

DROP_SQL = BLOCK_SQL + """,
ranked AS (SELECT run_id, layer, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, layer) AS rnk FROM sim),
kept AS (SELECT run_id, layer, row_number() OVER (PARTITION BY run_id ORDER BY layer) - 1 AS new_layer FROM ranked WHERE rnk > 3)
"""


def _plan(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(reserved, dropped) layers of each run when its three best-scored layers go."""
    from corpusflow.operators.selection import complement, select_drop
    from corpusflow.operators.similarity import block_similarity
    from corpusflow.session import written

    sim = written(block_similarity(layer_states(spark, sf)), "similarity")
    dropped = select_drop(sim, 3, ["run_id"])
    return complement(sim.select("run_id", "layer"), dropped, ["run_id", "layer"]), dropped


@query(
    "SNK-01",
    "WITH " + DROP_SQL + """
    SELECT run_id, '[' || string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) || ']' AS reserved_layers,
           '{' || string_agg('"' || layer || '":' || new_layer, ',' ORDER BY layer) || '}' AS layer_mapping
    FROM kept GROUP BY run_id
    """,
)
def plan_files(spark: SparkSession, sf: str) -> DataFrame:
    from corpusflow.operators.selection import plan_json

    path = scratch_path(spark, "plans")
    sinks.write_plan_json(plan_json(_plan(spark, sf)[0]), path)
    parts = [spark.read.schema("value string, run_id string").text(f"{path}/{k}").withColumnRenamed("value", k) for k in ("reserved_layers", "layer_mapping")]
    return parts[0].join(parts[1], "run_id")


@query(
    "SNK-02",
    f"""
    SELECT doc_id, p AS token, round(least(p, 4096) * 4096 * 32 / 1048576.0, 2) AS allocated_mib
    FROM (SELECT doc_id, unnest(range(1, len({tokens_sql('text')}) + 1)) AS p FROM documents) WHERE p % 1000 = 0
    """,
)
def growth_file(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", F.posexplode(whitespace(F.col("text"))).alias("pos", "t"))
    sized = docs.select("doc_id", "pos", (F.least(F.col("pos") + 1, F.lit(4096)).cast("long") * 4096 * 32).alias("bytes"))
    path = scratch_path(spark, "growth")
    sinks.write_growth_csv(sinks.growth_rows(sized, "bytes"), path)
    return spark.read.schema("doc_id long, token long, allocated_mib double").csv(path, header=True)


@query(
    "SNK-03",
    """
    SELECT m || '=' || printf(CASE m WHEN 'ppl' THEN '%.4f' WHEN 'num_eval_tokens' THEN '%.0f' ELSE '%.2f' END, v) AS line
    FROM (SELECT 'ppl' AS m, avg(n_chars) / 7.0 AS v FROM documents UNION ALL SELECT 'elapsed_s', sum(n_chars) / 3.0 FROM documents
          UNION ALL SELECT 'num_eval_tokens', count(*) * 1.0 FROM documents)
    """,
)
def metric_sink(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").agg(
        (F.avg("n_chars") / 7.0).alias("ppl"), (F.sum("n_chars") / 3.0).alias("elapsed_s"), F.count(F.lit(1)).cast("double").alias("num_eval_tokens")
    ).unpivot([], ["ppl", "elapsed_s", "num_eval_tokens"], "metric", "value")
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(m, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SNK-04", "SELECT event_type, count(*) AS steps, round(avg(value), 2) AS mean_value FROM events GROUP BY event_type")
def speed_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg("value"), 2).alias("mean_value"))
    path = scratch_path(spark, "speed")
    sinks.write_speed_csv(rows, path)
    return spark.read.schema("event_type string, steps long, mean_value double").csv(path, header=True)


# Alignment ---------------------------------------------------------------------------------------------------------


@query(
    "ALN-01",
    "SELECT d.doc_id, 1 AS n_prompt, 'user' AS role, text || chr(10) || lang AS content, CAST(quality AS VARCHAR) AS answer, '' AS system FROM documents d JOIN labels USING (doc_id)",
)
def alpaca(spark: SparkSession, sf: str) -> DataFrame:
    a = A.align_alpaca(instruction_rows(spark, sf), INSTRUCTIONS, ["doc_id"])
    last = F.element_at("prompt", -1)
    return a.select("doc_id", F.size("prompt").alias("n_prompt"), last["role"].alias("role"), last["content"].alias("content"), F.col("response")[0]["content"].alias("answer"), "system")


@query(
    "ALN-01:history",
    "SELECT doc_id, 'user:hello|assistant:' || lang || '|user:' || source || chr(10) || lang AS turns FROM documents JOIN labels USING (doc_id)",
)
def alpaca_history(spark: SparkSession, sf: str) -> DataFrame:
    spec = registry.DatasetSpec(name="ranking", history="history")
    a = A.align_alpaca(ranking_rows(spark, sf), spec, ["doc_id"])
    return a.select("doc_id", F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("turns"))


@query(
    "ALN-02",
    "SELECT doc_id, 2 AS n, 'assistant:good ' || quality || '|assistant:bad ' || toxic AS answers FROM documents JOIN labels USING (doc_id)",
)
def responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking_rows(spark, sf)
    r = A.responses_to_array(rows, "output")
    return rows.select("doc_id", F.size(r).alias("n"), F.array_join(F.transform(r, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("answers"))


@query(
    "ALN-03",
    "WITH " + CHAT_SQL + "SELECT conv_id, CAST(i AS INT) AS idx, CASE WHEN i < n - 1 THEN 'prompt' ELSE 'response' END AS part, role, text AS content, system FROM msg",
)
def sharegpt(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations as message rows, aligned turn by turn."""
    turns = table(spark, sf, "conversations")
    return A.align_conversations(turns, "conv_id", "turn", "role", "text", CHAT, id_chunk("turn", 1024), mode="drop")


@query(
    "ALN-04",
    "SELECT conv_id, CASE WHEN min_by(role, turn) = 'system' THEN min_by(text, turn) ELSE '' END AS system, count(*) - CASE WHEN min_by(role, turn) = 'system' THEN 1 ELSE 0 END AS n_rest FROM conversations GROUP BY conv_id",
)
def system_turn(spark: SparkSession, sf: str) -> DataFrame:
    system, rest = A.extract_system(F.col("conversations"), "from", "value", "system", F.lit(""))
    return chats(spark, sf).select("conv_id", system.alias("system"), F.size(rest).cast("long").alias("n_rest"))


@query("ALN-05", "SELECT conv_id, n - n % 2 AS n_even, n % 2 AS cut FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def even_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = chats(spark, sf)
    even = F.size(A.truncate_even(F.col("conversations"))).cast("long")
    return c.select("conv_id", even.alias("n_even"), (F.size("conversations") - even).alias("cut"))


@query(
    "ALN-06",
    """
    SELECT conv_id, bool_and(CASE WHEN i % 2 = 0 THEN role IN ('user', 'observation') ELSE role IN ('assistant', 'function_call') END) AS valid
    FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id
    """,
)
def role_order(spark: SparkSession, sf: str) -> DataFrame:
    """Role order of the raw turns, so conversations that open with a system message are invalid."""
    return chats(spark, sf).select("conv_id", A.turns_valid(F.col("conversations"), "from", CHAT).alias("valid"))


@query("ALN-07", "SELECT role AS canonical, count(*) AS n FROM conversations GROUP BY role")
def canonical_roles(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "conversations").select(registry.map_tags(F.col("role"), CHAT).alias("canonical"))
    return roles.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ALN-08",
    "SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || md5(text), '|' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id",
)
def assembled(spark: SparkSession, sf: str) -> DataFrame:
    return chats(spark, sf).select(
        "conv_id",
        F.size("conversations").cast("long").alias("n_turns"),
        F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit(":"), F.md5(m["value"]))), "|").alias("turns"),
    )


@query(
    "ALN-09",
    "WITH " + CHAT_SQL + """
    SELECT 'chat' AS kind, conv_id AS id, max(n) - 1 AS n_prompt, 1 AS n_response, any_value(system) AS system, '' AS tools FROM msg GROUP BY conv_id
    UNION ALL SELECT 'instruction', d.doc_id, 1, 1, '', '' FROM documents d JOIN labels USING (doc_id)
    """,
)
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    a = aligned_chats(spark, sf).withColumnRenamed("conv_id", "id").withColumn("kind", F.lit("chat"))
    b = A.align(instruction_rows(spark, sf), INSTRUCTIONS, ["doc_id"]).withColumnRenamed("doc_id", "id").withColumn("kind", F.lit("instruction"))
    return a.unionByName(b).select("kind", "id", F.size("prompt").cast("long").alias("n_prompt"), F.size("response").alias("n_response"), "system", "tools")


@query("FLT-01", "WITH " + CHAT_SQL + "SELECT conv_id, max(n) - 1 AS n_prompt FROM msg GROUP BY conv_id")
def sft_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.valid_sft(aligned_chats(spark, sf)).select("conv_id", F.size("prompt").cast("long").alias("n_prompt"))


@query("FLT-02", "SELECT doc_id, 3 AS n_prompt FROM documents JOIN labels USING (doc_id)")
def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    a = A.align_alpaca(ranking_rows(spark, sf), registry.DatasetSpec(name="r", history="history"), ["doc_id"])
    return A.valid_prompt(a).select("doc_id", F.size("prompt").alias("n_prompt"))


@query("FLT-03", "SELECT doc_id, 2 AS n_response FROM documents JOIN labels USING (doc_id)")
def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    a = A.align_alpaca(ranking_rows(spark, sf), INSTRUCTIONS, ["doc_id"])
    return A.valid_pair(a).select("doc_id", F.size("response").alias("n_response"))


@query("FLT-05", r"SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '\S')")
def non_blank(spark: SparkSession, sf: str) -> DataFrame:
    return A.nonempty_text(table(spark, sf, "documents"), "text").select("doc_id", F.length("text").alias("n"))


# Templates ---------------------------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return A.align_conversations(turns, "conv_id", "turn", "role", "text", CHAT, id_chunk("turn", 1024), mode="drop")


def _rendered(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """Every message in every template: one scan, each row carries its few renderings."""
    texts = [
        F.struct(
            F.lit(name).alias("template"),
            R.Renderer(get_template(name), "<s>", "</s>").row_text(F.col("role"), F.col("content"), F.col("idx"), F.col("system"), None).alias("text"),
        )
        for name in names
    ]
    rows = _messages(spark, sf).select("conv_id", F.col("idx").cast("long").alias("idx"), F.inline(F.array(*texts)))
    return rows.select("conv_id", "idx", "template", F.length("text").alias("n"), F.md5("text").alias("h"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ALPACA_SYSTEM, _VICUNA_SYSTEM = (_quoted(TEMPLATES[t].default_system) for t in ("alpaca", "vicuna"))


@query(
    "TPL-01",
    "WITH " + CHAT_SQL + f""",
    r AS (
      SELECT conv_id, 'alpaca' AS template, i,
        CASE WHEN i = 0 THEN CASE WHEN system = '' THEN {_ALPACA_SYSTEM} ELSE system END WHEN i % 2 = 0 THEN chr(10) || chr(10) ELSE '' END
        || CASE WHEN i % 2 = 0 THEN '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) ELSE text || '</s>' END AS t FROM msg
      UNION ALL SELECT conv_id, 'chatml', i,
        CASE WHEN i = 0 AND system <> '' THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) WHEN i > 0 AND i % 2 = 0 THEN chr(10) ELSE '' END
        || CASE WHEN i % 2 = 0 THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text || '</s>' END FROM msg
      UNION ALL SELECT conv_id, 'vicuna', i,
        CASE WHEN i = 0 THEN CASE WHEN system = '' THEN {_VICUNA_SYSTEM} ELSE system END ELSE '' END
        || CASE WHEN i % 2 = 0 THEN 'USER: ' || text || ' ASSISTANT:' ELSE text || '</s>' END FROM msg)
    SELECT conv_id, i AS idx, template, length(t) AS n, md5(t) AS h FROM r
    """,
)
def rendered(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, ["alpaca", "chatml", "vicuna"])


@query(
    "TPL-02",
    "WITH " + CHAT_SQL + f""",
    r AS (SELECT conv_id, i, CASE WHEN i % 2 = 0 THEN '<s>[INST] ' || CASE WHEN i = 0 THEN '<<SYS>>' || chr(10) || CASE WHEN system = '' THEN {_quoted(TEMPLATES['llama2_zh'].default_system)} ELSE system END
                 || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]' ELSE text || '</s>' END AS t FROM msg)
    SELECT conv_id, i AS idx, 'llama2_zh' AS template, length(t) AS n, md5(t) AS h FROM r
    """,
)
def rendered_inline(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, ["llama2_zh"])


_NAMES = list(TEMPLATES)
_TEMPLATE_ROWS = ", ".join(
    f"({i}, '{t.name}', {len(t.slots('user'))}, {len(t.slots('assistant'))}, {len(t.default_system)}, {_quoted(special_tokens(t)['eos'])}, {len(special_tokens(t)['additional'])})"
    for i, t in enumerate(TEMPLATES.values())
)


@query(
    "TPL-03",
    f"""
    WITH t(i, name, user_slots, assistant_slots, system_chars, eos, additional) AS (VALUES {_TEMPLATE_ROWS})
    SELECT conv_id, name, user_slots, assistant_slots, system_chars FROM (SELECT DISTINCT conv_id FROM conversations) JOIN t ON conv_id % {len(_NAMES)} = i
    """,
)
def template_of_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations dealt to all templates in turn and joined with the template table."""
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    named = ids.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("conv_id") % len(_NAMES) + 1).cast("int")))
    return named.join(F.broadcast(templates_df(spark)), "name").select(
        "conv_id", "name", F.size("user_slots").alias("user_slots"), F.size("assistant_slots").alias("assistant_slots"), F.length("default_system").alias("system_chars")
    )


@query(
    "TPL-04",
    "SELECT doc_id, '[Round ' || CAST(doc_id // 2 AS VARCHAR) || ']' || chr(10) || chr(10) || '问：' || source || '{{idx}}' || chr(10) || chr(10) || '答：' AS filled FROM documents",
)
def filled_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Content that looks like a placeholder stays as it is."""
    slot = get_template("chatglm2").user[0]
    values = {"content": F.concat("source", F.lit("{{idx}}")), "idx": F.floor(F.col("doc_id") / 2).cast("string")}
    return table(spark, sf, "documents").select("doc_id", R.fill_slot(slot, values).alias("filled"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}"))
    return table(spark, sf, "events").select("event_id", content.alias("content"))


@query("TPL-06", "SELECT event_id, 'Action: ' || event_type || chr(10) || 'Action Input: ' || props AS text FROM events")
def function_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("event_id", R.render_function_call(F.col("content")).alias("text"))


@query(
    "TPL-07",
    f"""
    SELECT p_partkey, {_quoted(R.TOOL_PROMPT_HEAD)} || '> Tool Name: part_' || p_partkey || chr(10) || 'Tool Description: ' || p_name || chr(10) || 'Tool Args:' || chr(10)
      || '  - size (integer): size ' || p_size || ', where each item should be number' || chr(10)
      || '  - brand (string, required): ' || p_brand || ', should be one of [' || p_type || ', other]' || chr(10)
      || chr(10) || {_quoted(R.TOOL_PROMPT_USE)} || 'part_' || p_partkey || {_quoted(R.TOOL_PROMPT_INPUT + R.TOOL_PROMPT_JSON + R.TOOL_PROMPT_TAIL)} AS text
    FROM part
    """,
)
def tool_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A tool description per part, as JSON text whose key order must survive."""
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substr(quoted(c), F.lit(2))
    bare = lambda c: F.regexp_replace(inner(c), r"\]$", "")
    tools = F.concat(
        F.lit('[{"name": "part_'), F.col("p_partkey").cast("string"), F.lit('", "description": '), bare(F.col("p_name")),
        F.lit(', "parameters": {"properties": {"size": {"type": "integer", "description": "size '), F.col("p_size").cast("string"),
        F.lit('", "items": {"type": "number"}}, "brand": {"type": "string", "description": '), bare(F.col("p_brand")),
        F.lit(', "enum": ['), bare(F.col("p_type")), F.lit(', "other"]}}, "required": ["brand"]}}]'),
    )
    return table(spark, sf, "part").select("p_partkey", R.render_tools(tools).alias("text"))


@query("TPL-08", "SELECT event_id, true AS is_tool, event_type AS name, props AS arguments FROM events")
def actions(spark: SparkSession, sf: str) -> DataFrame:
    text = R.render_function_call(F.col("content"))
    return _calls(spark, sf).select("event_id", R.extract_action(text).alias("a")).select("event_id", "a.*")


@query(
    "TPL-09",
    f"""
    WITH t(i, name, user_slots, assistant_slots, system_chars, eos, additional) AS (VALUES {_TEMPLATE_ROWS})
    SELECT name, eos, eos AS pad, additional, count(*) AS conversations FROM (SELECT DISTINCT conv_id FROM conversations) JOIN t ON conv_id % {len(_NAMES)} = i GROUP BY ALL
    """,
)
def template_specials(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    named = ids.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("conv_id") % len(_NAMES) + 1).cast("int")))
    special = templates_df(spark).select("name", "eos", "pad", F.size("additional_tokens").alias("additional"))
    return named.join(F.broadcast(special), "name").groupBy("name", "eos", "pad", "additional").agg(F.count(F.lit(1)).alias("conversations"))


@query(
    "TPL-10",
    "WITH " + CHAT_SQL + f""",
    r AS (SELECT conv_id, i, CASE WHEN i % 2 = 0 THEN (CASE WHEN i = 0 THEN {tokens_sql('system')} ELSE [] END) || ['<reserved_106>'] || {tokens_sql('text')} || ['<reserved_107>'] ELSE {tokens_sql('text')} END AS t FROM msg)
    SELECT conv_id, i AS idx, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM r
    """,
)
def slot_tokens(spark: SparkSession, sf: str) -> DataFrame:
    renderer = R.Renderer(get_template("baichuan2"), "<s>", "</s>")
    toks = renderer.row_tokens(F.col("role"), F.col("content"), F.col("idx"), F.col("system"), None, whitespace)
    rows = _messages(spark, sf).select("conv_id", "idx", toks.alias("t"))
    return rows.select("conv_id", F.col("idx").cast("long").alias("idx"), F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


@query(
    "JOIN-10",
    "WITH f(i, family, template) AS (VALUES "
    + ", ".join(f"({i}, '{f}', {repr(FAMILY_TEMPLATES[f]) if f in FAMILY_TEMPLATES else 'NULL'})" for i, f in enumerate([*FAMILY_TEMPLATES, *PLAIN_FAMILIES]))
    + f") SELECT family || '-' || s_suppkey || 'B-Chat' AS model, template FROM supplier JOIN f ON s_suppkey % {len(FAMILY_TEMPLATES) + len(PLAIN_FAMILIES)} = i",
)
def default_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Model names dealt over all families; the family is the part before the first dash."""
    names = [*FAMILY_TEMPLATES, *PLAIN_FAMILIES]
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % len(names) + 1).cast("int"))
    models = table(spark, sf, "supplier").select(F.concat(pick, F.lit("-"), F.col("s_suppkey").cast("string"), F.lit("B-Chat")).alias("model"))
    keyed = models.withColumn("family", F.split_part("model", F.lit("-"), F.lit(1)))
    return keyed.join(F.broadcast(families_df(spark)), "family", "left").select("model", "template")


# Strings -----------------------------------------------------------------------------------------------------------


@query(
    "STR-F1",
    """
    WITH j AS (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS corpus FROM documents GROUP BY source),
    o AS (SELECT doc_id, source, length(text) AS n, CAST(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) - length(text) - 2 AS start FROM documents)
    SELECT o.doc_id, o.source, o.start, o.start + o.n AS "end", md5(substr(corpus, CAST(o.start + 1 AS BIGINT), o.n)) AS h FROM o JOIN j USING (source)
    """,
)
def corpus_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    placed = join_corpus(docs, "text", ["source"], ["doc_id"], id_chunk("doc_id"))
    return placed.select("doc_id", "source", "start", "end", F.md5(F.when(F.col("start") == 0, F.col("piece")).otherwise(F.expr("substr(piece, 3)"))).alias("h"))


@query("STR-F2", "SELECT doc_id, md5(text || '</s>') AS h FROM documents")
def with_eos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(append_eos(F.col("text"), "</s>")).alias("h"))


@query("STR-F4", "SELECT l_orderkey, l_linenumber, l_linenumber AS layer FROM lineitem")
def layer_numbers(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("model.layers."), F.col("l_linenumber").cast("string"), F.lit(".mlp.weight"))
    return li.select("l_orderkey", "l_linenumber", layer_of(name).alias("layer"))

