"""Queries: tokens, vocabularies, training examples, packing, mixing and splitting."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.templates import get_template
from corpusflow.functions.tokenizers import (
    build_vocab,
    characters,
    decode,
    to_ids,
    to_ids_by_join,
    token_lengths,
    tokenize,
    words_and_marks,
)
from corpusflow.operators import examples as E
from corpusflow.operators import mixing as M
from corpusflow.operators.prepare import prepare
from corpusflow.operators.align import align_alpaca, align_conversations, message
from corpusflow.operators.ordering import id_chunk, positions, running_total
from corpusflow.plans.catalog import CHAT, CHAT_SQL, SQL, aligned_chats, documents, query, ranking_rows, table, tokens_sql
from corpusflow.schema import IGNORE
from corpusflow.session import scratch_path, written
from corpusflow.sources.sinks import write_examples

VOCAB, CUTOFF, BLOCK, BATCH_ROWS = 2000, 200, 256, 100
SPECIALS = ["<unk>", "</s>", "<s>"]


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize(documents(spark, sf), "text").drop("text")


# Tokens --------------------------------------------------------------------------------------------------------------


@query("TOK-01", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def whitespace_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return doc_tokens(spark, sf).select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("h"))


@query(
    "TOK-01:characters",
    "SELECT doc_id, length(text) AS n, md5(array_to_string(string_split(text, ''), '|')) AS h FROM documents",
)
def character_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", characters(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("h"))


@query(
    "TOK-01:words",
    r"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]') AS t FROM documents)",
)
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", words_and_marks(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


DOC_VOCAB_SQL = f"""
toks AS (SELECT doc_id, unnest({tokens_sql('text')}) AS token, generate_subscripts({tokens_sql('text')}, 1) AS p FROM documents),
counts AS (SELECT token, count(*) AS n FROM toks WHERE token NOT IN ('<unk>', '</s>', '<s>') GROUP BY token),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INT) AS token_id, n FROM counts
          QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB - 3}
          UNION ALL SELECT * FROM (VALUES ('<unk>', 0, NULL), ('</s>', 1, NULL), ('<s>', 2, NULL)))
"""


def doc_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return build_vocab(doc_tokens(spark, sf), "tokens", VOCAB, SPECIALS)


@query("TOK-02", "WITH " + DOC_VOCAB_SQL + "SELECT token, token_id, n FROM vocab")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return doc_vocab(spark, sf)


@query(
    "TOK-03",
    "WITH " + DOC_VOCAB_SQL + """
    SELECT doc_id, string_agg(CASE WHEN v.token IS NULL THEN '<unk>' ELSE t.token END, ' ' ORDER BY p) AS text
    FROM toks t LEFT JOIN vocab v USING (token) GROUP BY doc_id
    """,
)
def decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with ignored positions in between, decoded without them."""
    vocab = written(doc_vocab(spark, sf), "vocab")
    ids = to_ids(doc_tokens(spark, sf), "tokens", vocab, "ids")
    noisy = ids.where(F.size("ids") > 0).withColumn("labels", F.concat(F.array(F.lit(IGNORE)), "ids", F.array(F.lit(IGNORE))))
    return decode(noisy, "labels", vocab, "text", skip=IGNORE).select("doc_id", "text")


@query("TOK-04", f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens FROM documents")
def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return token_lengths(doc_tokens(spark, sf)).select("doc_id", "n_tokens")


IDS_SQL = """
SELECT doc_id, count(*) AS n, md5(string_agg(CAST(coalesce(token_id, 0) AS VARCHAR), ',' ORDER BY p)) AS ids
FROM toks LEFT JOIN vocab USING (token) GROUP BY doc_id
"""


def _ids_out(df: DataFrame) -> DataFrame:
    return df.where(F.size("ids") > 0).select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids"))


@query("JOIN-09", "WITH " + DOC_VOCAB_SQL + IDS_SQL)
def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _ids_out(to_ids(doc_tokens(spark, sf), "tokens", doc_vocab(spark, sf), "ids"))


@query("JOIN-09:join", "WITH " + DOC_VOCAB_SQL + IDS_SQL)
def token_ids_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a vocabulary that is joined instead of shipped."""
    vocab = written(doc_vocab(spark, sf), "vocab")
    return _ids_out(to_ids_by_join(doc_tokens(spark, sf), "doc_id", "tokens", vocab, "ids"))


@query(
    "WIN-02",
    f"""
    SELECT doc_id, doc_id // {BATCH_ROWS} AS batch, n AS n_tokens, CAST(sum(n) OVER (PARTITION BY doc_id // {BATCH_ROWS} ORDER BY doc_id) - n AS BIGINT) AS batch_offset,
           CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS corpus_offset
    FROM (SELECT doc_id, len({tokens_sql('text')}) AS n FROM documents)
    """,
)
def offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Token offset of each document in its batch and in the whole corpus."""
    docs = E.batches(token_lengths(doc_tokens(spark, sf)).drop("tokens"), "doc_id", None, BATCH_ROWS)
    chunk = id_chunk("doc_id")
    local = running_total(docs, "n_tokens", ["batch"], ["doc_id"], chunk, "batch_offset", exclusive=True)
    return running_total(local, "n_tokens", [], ["doc_id"], chunk, "corpus_offset", exclusive=True)


# Examples --------------------------------------------------------------------------------------------------------


@query(
    "PRE-01",
    "WITH " + DOC_VOCAB_SQL + f""",
    ended AS (SELECT doc_id, token, p FROM toks UNION ALL SELECT doc_id, '</s>', 1000000000 FROM documents),
    placed AS (SELECT doc_id // {BATCH_ROWS} AS batch, coalesce(token_id, 0) AS id,
                      row_number() OVER (PARTITION BY doc_id // {BATCH_ROWS} ORDER BY doc_id, p) - 1 AS o
               FROM ended LEFT JOIN vocab USING (token))
    SELECT batch, o // {BLOCK} AS block, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY o)) AS ids
    FROM placed GROUP BY ALL HAVING count(*) = {BLOCK}
    """,
)
def packed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = doc_tokens(spark, sf).withColumn("tokens", F.concat("tokens", F.array(F.lit("</s>"))))
    ids = to_ids(docs, "tokens", doc_vocab(spark, sf), "ids")
    packed = E.pack_pretrain(ids, "ids", "doc_id", BLOCK, batch_rows=BATCH_ROWS)
    return packed.select("batch", "block", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join("input_ids", ",")).alias("ids"))


def _message_sql(template: str) -> str:
    """Tokens per message for two of the templates: chatml marks EOS per answer, falcon once at the end."""
    if template == "chatml":
        first = "'<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10)"
        user = "'<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
        answer = f"{tokens_sql('text')} || ['</s>']"
    else:
        first, user, answer = "system", "'User: ' || text || chr(10) || 'Falcon:'", tokens_sql("text")
    return f"""
    tok AS (SELECT conv_id, i, n, CASE WHEN i % 2 = 0 THEN (CASE WHEN i = 0 AND system <> '' THEN {tokens_sql(first)} ELSE [] END) || {tokens_sql(user)}
                                   ELSE {answer} END AS t FROM msg),
    flat AS (SELECT conv_id, i, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM tok),
    counts AS (SELECT token, count(*) AS n FROM flat WHERE token NOT IN ('<unk>', '</s>', '<s>') GROUP BY token),
    vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INT) AS token_id FROM counts
              QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB - 3}
              UNION ALL SELECT * FROM (VALUES ('<unk>', 0), ('</s>', 1), ('<s>', 2))),
    enc AS (SELECT conv_id, i, list(coalesce(token_id, 0) ORDER BY p) AS ids FROM flat LEFT JOIN vocab USING (token) GROUP BY ALL),
    pairs AS (SELECT t.conv_id, t.i // 2 AS k, max(t.n) // 2 AS np,
                     coalesce(any_value(ids) FILTER (WHERE t.i % 2 = 0), []) AS s, coalesce(any_value(ids) FILTER (WHERE t.i % 2 = 1), []) AS a
              FROM tok t LEFT JOIN enc e ON e.conv_id = t.conv_id AND e.i = t.i GROUP BY ALL)
    """


def _fold_sql(cutoff: int) -> str:
    """Pairs cut to what the pairs before them left of the cutoff."""
    share = "greatest(coalesce(CAST(floor({m} * (CAST(len(a) AS DOUBLE) / nullif(len(s) + len(a), 0))) AS INT), 0), 1)"
    here, later = share.format(m=cutoff), share.format(m=f"({cutoff} - used)")
    return f"""
    fold AS (
      SELECT conv_id, k, s[1:greatest({cutoff} - b, 0)] AS s, a[1:b] AS a, CAST(len(s[1:greatest({cutoff} - b, 0)]) + len(a[1:b]) AS BIGINT) AS used
      FROM (SELECT *, {here} AS b FROM pairs WHERE k = 0)
      UNION ALL
      SELECT conv_id, k, s[1:greatest({cutoff} - used - b, 0)], a[1:b], CAST(used + len(s[1:greatest({cutoff} - used - b, 0)]) + len(a[1:b]) AS BIGINT)
      FROM (SELECT p.conv_id, p.k, p.s, p.a, f.used, {later.replace('len(a)', 'len(p.a)').replace('len(s)', 'len(p.s)')} AS b
            FROM fold f JOIN pairs p ON p.conv_id = f.conv_id AND p.k = f.k + 1 WHERE f.used < {cutoff}))
    """


def _ignored(n: str) -> str:
    return f"list_transform(range({n}), lambda x: -100)"


def _text(column: str) -> str:
    return f"array_to_string({column}, ',')"


def _encoding(spark: SparkSession, sf: str, template: str) -> tuple[DataFrame, E.Encoding]:
    chat = aligned_chats(spark, sf)
    enc = E.make_encoding(chat, template, VOCAB, has_tools=False)
    return chat, replace(enc, vocab=written(enc.vocab, "vocab"))


def _joined(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    return df.select(*keys, *[F.array_join(a, ",").alias(a) for a in arrays])


@query(
    "PRE-02",
    "WITH RECURSIVE " + CHAT_SQL + "," + _message_sql("chatml") + "," + _fold_sql(CUTOFF) + f"""
    SELECT conv_id, {_text('flatten(list(s || a ORDER BY k))')} AS input_ids, {_text(f"flatten(list({_ignored('len(s)')} || a ORDER BY k))")} AS labels,
           CAST(sum(len(s) + len(a)) AS BIGINT) AS n
    FROM fold GROUP BY conv_id
    """,
)
def sft_examples(spark: SparkSession, sf: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, "chatml")
    out = E.encode_sft(chat, enc, ["conv_id"], CUTOFF)
    return _joined(out.withColumn("n", F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)), ["conv_id", "n"], ["input_ids", "labels"])


@query(
    "PRE-02:efficient_eos",
    "WITH RECURSIVE " + CHAT_SQL + "," + _message_sql("falcon") + "," + _fold_sql(CUTOFF) + f"""
    SELECT conv_id, {_text('flatten(list(s || a ORDER BY k)) || [1]')} AS input_ids,
           {_text(f"flatten(list(CASE WHEN k > 0 THEN [1] || {_ignored('len(s) - 1')} ELSE {_ignored('len(s)')} END || a ORDER BY k)) || [1]")} AS labels
    FROM fold GROUP BY conv_id
    """,
)
def sft_examples_efficient(spark: SparkSession, sf: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, "falcon")
    return _joined(E.encode_sft(chat, enc, ["conv_id"], CUTOFF), ["conv_id"], ["input_ids", "labels"])


def _packed_sql(template: str) -> str:
    tail = "[1]" if template == "falcon" else "[]"
    first = "k = 0 AND rk = 1" if template == "falcon" else "true"
    return f"""
    numbered_conv AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // {BATCH_ROWS} AS batch,
                             row_number() OVER (PARTITION BY (rn - 1) // {BATCH_ROWS} ORDER BY conv_id) AS rk,
                             row_number() OVER (PARTITION BY (rn - 1) // {BATCH_ROWS} ORDER BY conv_id DESC) AS back
                      FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS rn FROM (SELECT DISTINCT conv_id FROM msg))),
    labelled AS (SELECT batch, conv_id, k, s || a || CASE WHEN back = 1 AND k = np - 1 THEN {tail} ELSE [] END AS ids,
                        CASE WHEN {first} THEN {_ignored('len(s)')} ELSE [1] || {_ignored('len(s) - 1')} END || a || CASE WHEN back = 1 AND k = np - 1 THEN {tail} ELSE [] END AS labels
                 FROM pairs JOIN numbered_conv USING (conv_id)),
    cells AS (SELECT batch, id, label, row_number() OVER (PARTITION BY batch ORDER BY conv_id, k, p) - 1 AS o
              FROM (SELECT batch, conv_id, k, unnest(ids) AS id, unnest(labels) AS label, generate_subscripts(ids, 1) AS p FROM labelled))
    SELECT batch, o // {BLOCK} AS block, string_agg(CAST(id AS VARCHAR), ',' ORDER BY o) AS input_ids, string_agg(CAST(label AS VARCHAR), ',' ORDER BY o) AS labels
    FROM cells GROUP BY ALL HAVING count(*) = {BLOCK} AND max(label) <> -100
    """


def _packed(spark: SparkSession, sf: str, template: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, template)
    return _joined(E.pack_sft(chat, enc, "conv_id", BLOCK, id_chunk("conv_id"), BATCH_ROWS), ["batch", "block"], ["input_ids", "labels"])


@query("PRE-03", "WITH " + CHAT_SQL + "," + _message_sql("chatml") + "," + _packed_sql("chatml"))
def packed_chats(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "chatml")


@query("PRE-03:efficient_eos", "WITH " + CHAT_SQL + "," + _message_sql("falcon") + "," + _packed_sql("falcon"))
def packed_chats_efficient(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, "falcon")


@query(
    "FLT-04",
    "WITH " + CHAT_SQL + "," + _message_sql("chatml") + f"""
    SELECT conv_id, k, len(s) AS n_source, len(a) AS n_target FROM pairs WHERE len(a) > 0
    """,
)
def not_all_ignored(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair as a block of its own: only those without any answer token are dropped."""
    chat, enc = _encoding(spark, sf, "chatml")
    ids = E.message_ids(chat, {"_ids": F.concat("prompt", "response")}, enc, ["conv_id"])
    ids = ids.select("conv_id", F.posexplode(E.pair_up(F.col("_ids"))).alias("k", "p"))
    blocks = ids.withColumn("labels", F.concat(E.mask_source(F.col("p.source"), F.lit(0), None), F.col("p.target")))
    return E.drop_all_ignored(blocks).select("conv_id", F.col("k").cast("long").alias("k"), F.size("p.source").alias("n_source"), F.size("p.target").alias("n_target"))


@query(
    "PRE-04",
    "WITH RECURSIVE " + CHAT_SQL + "," + _message_sql("chatml") + "," + _fold_sql(CUTOFF) + f""",
    last AS (SELECT conv_id, max(k) AS lk FROM fold GROUP BY conv_id)
    SELECT conv_id, {_text('flatten(list(CASE WHEN k < lk THEN s || a ELSE s END ORDER BY k))')} AS input_ids,
           {_text('flatten(list(CASE WHEN k < lk THEN [] ELSE a END ORDER BY k))')} AS labels
    FROM fold JOIN last USING (conv_id) GROUP BY conv_id
    """,
)
def prompt_examples(spark: SparkSession, sf: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, "chatml")
    return _joined(E.encode_prompt_only(chat, enc, ["conv_id"], CUTOFF), ["conv_id"], ["input_ids", "labels"])


def _message_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned chats as message rows; no conversation is put into one record."""
    return align_conversations(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", CHAT, id_chunk("turn", 1024), mode="drop")


@query("PRE-02:turns", SQL["PRE-02"])
def sft_from_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets from token counts per message; only messages that get a place are put together."""
    out = E.encode_turns(_message_rows(spark, sf), "conv_id", _encoding(spark, sf, "chatml")[1], CUTOFF)
    return _joined(out.withColumn("n", F.size("input_ids").cast("long")), ["conv_id", "n"], ["input_ids", "labels"])


@query("PRE-04:turns", SQL["PRE-04"])
def prompts_from_turns(spark: SparkSession, sf: str) -> DataFrame:
    out = E.encode_turns(_message_rows(spark, sf), "conv_id", _encoding(spark, sf, "chatml")[1], CUTOFF, stage="ppo")
    return _joined(out, ["conv_id"], ["input_ids", "labels"])


PAIR_CUTOFF = 9


@query(
    "PRE-05",
    f"""
    WITH r AS (SELECT doc_id, ['User:', 'hello', 'Falcon:'] AS s0, [lang] AS a0, ['User:', source, lang, 'Falcon:'] AS s1,
                      ['good', CAST(quality AS VARCHAR)] AS good, ['bad', CAST(toxic AS VARCHAR)] AS bad FROM documents JOIN labels USING (doc_id)),
    flat AS (SELECT unnest(s0 || a0 || s1 || good || bad) AS token FROM r),
    counts AS (SELECT token, count(*) AS n FROM flat GROUP BY token),
    vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INT) AS id FROM counts),
    cut AS (SELECT doc_id, s0[1:{PAIR_CUTOFF} - b0] AS s0, a0[1:b0] AS a0, {PAIR_CUTOFF} - len(s0[1:{PAIR_CUTOFF} - b0]) - len(a0[1:b0]) AS rest, s1, good, bad
            FROM (SELECT *, greatest(CAST(floor({PAIR_CUTOFF} * (CAST(1 AS DOUBLE) / 4)) AS INT), 1) AS b0 FROM r)),
    two AS (SELECT doc_id, s0 || a0 || s1[1:rest - b1] AS prompt, good[1:b1] AS good, bad[1:b1] AS bad
            FROM (SELECT *, greatest(CAST(floor(rest * (CAST(2 AS DOUBLE) / 6)) AS INT), 1) AS b1 FROM cut)),
    e AS (SELECT doc_id, 'prompt_ids' AS part, unnest(prompt) AS token, generate_subscripts(prompt, 1) AS p FROM two
          UNION ALL SELECT doc_id, 'chosen_ids', unnest(good), generate_subscripts(good, 1) FROM two
          UNION ALL SELECT doc_id, 'rejected_ids', unnest(bad), generate_subscripts(bad, 1) FROM two),
    g AS (SELECT doc_id, part, string_agg(CAST(id AS VARCHAR), ',' ORDER BY p) AS ids FROM e JOIN vocab USING (token) GROUP BY ALL)
    SELECT doc_id, max(ids) FILTER (part = 'prompt_ids') AS prompt_ids, max(ids) FILTER (part = 'chosen_ids') || ',1' AS chosen_ids,
           max(ids) FILTER (part = 'rejected_ids') || ',1' AS rejected_ids
    FROM g GROUP BY doc_id
    """,
)
def preference_examples(spark: SparkSession, sf: str) -> DataFrame:
    from corpusflow.sources.registry import DatasetSpec

    aligned = align_alpaca(ranking_rows(spark, sf), DatasetSpec(name="r", history="history"), ["doc_id"])
    enc = E.make_encoding(aligned, "falcon", 100_000, has_tools=False)
    enc = replace(enc, vocab=written(enc.vocab, "vocab"))
    return _joined(E.encode_pairs(aligned, enc, ["doc_id"], PAIR_CUTOFF), ["doc_id"], ["prompt_ids", "chosen_ids", "rejected_ids"])


@query(
    "PRE-06",
    """
    SELECT l_orderkey, l_linenumber, greatest(1, CAST(floor(1024 * (l_quantity / (l_quantity + l_extendedprice / 100))) AS INT)) AS target,
           1024 - greatest(1, CAST(floor(1024 * (l_quantity / (l_quantity + l_extendedprice / 100))) AS INT)) AS source
    FROM lineitem
    """,
)
def budgets(spark: SparkSession, sf: str) -> DataFrame:
    s, t = E.infer_max_len(F.col("l_extendedprice") / 100, F.col("l_quantity"), F.lit(1024), 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("target"), s.alias("source"))


@query(
    "PRE-07",
    "WITH RECURSIVE " + CHAT_SQL + "," + _message_sql("chatml") + "," + _fold_sql(CUTOFF)
    + "SELECT conv_id, k, len(s) AS n_source, len(a) AS n_target FROM fold",
)
def truncated(spark: SparkSession, sf: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, "chatml")
    ids = E.message_ids(chat, {"_ids": F.concat("prompt", "response")}, enc, ["conv_id"])
    cut = E.truncate_pairs(E.pair_up(F.col("_ids")), CUTOFF)
    rows = ids.select("conv_id", F.posexplode(cut).alias("k", "p"))
    return rows.select("conv_id", F.col("k").cast("long").alias("k"), F.size("p.source").alias("n_source"), F.size("p.target").alias("n_target"))


@query(
    "PRE-08",
    f"""
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string({_ignored('n')}, ',') ELSE array_to_string([1] || {_ignored('n - 1')}, ',') END AS labels
    FROM (SELECT doc_id, len({tokens_sql('text')}) AS n FROM documents)
    """,
)
def masked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the sources of turn 0 (even ids) or 1 (odd ids)."""
    mask = E.mask_source(F.transform("tokens", lambda _: F.lit(5)), F.col("doc_id") % 2, 1)
    return doc_tokens(spark, sf).select("doc_id", F.array_join(mask, ",").alias("labels"))


@query(
    "PRE-09",
    "WITH " + CHAT_SQL + "," + _message_sql("chatml") + f""",
    last AS (SELECT *, max(k) OVER (PARTITION BY conv_id) AS lk FROM pairs)
    SELECT conv_id, {_text('flatten(list(CASE WHEN k < lk THEN s || a ELSE s END ORDER BY k))')} AS prompt, {_text('flatten(list(CASE WHEN k < lk THEN [] ELSE a END ORDER BY k))')} AS answer
    FROM last GROUP BY conv_id
    """,
)
def one_turn(spark: SparkSession, sf: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, "chatml")
    ids = E.message_ids(chat, {"_ids": F.concat("prompt", "response")}, enc, ["conv_id"])
    prompt, answer = E.flatten_one_turn(E.pair_up(F.col("_ids")))
    return _joined(ids.select("conv_id", prompt.alias("prompt"), answer.alias("answer")), ["conv_id"], ["prompt", "answer"])


@query("PRE-10", f"SELECT doc_id, len({tokens_sql('text')}) AS ones FROM documents")
def masks(spark: SparkSession, sf: str) -> DataFrame:
    mask = E.attention_mask(F.col("tokens"))
    return doc_tokens(spark, sf).select("doc_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"))


@query(
    "PRE-11",
    "WITH RECURSIVE " + CHAT_SQL + "," + _message_sql("chatml") + "," + _fold_sql(CUTOFF) + f""",
    last AS (SELECT conv_id, max(k) AS lk FROM fold GROUP BY conv_id)
    SELECT 'sft' AS stage, conv_id, CAST(sum(len(s) + len(a)) AS BIGINT) AS n FROM fold GROUP BY conv_id
    UNION ALL SELECT 'ppo', conv_id, CAST(sum(CASE WHEN k < lk THEN len(s) + len(a) ELSE len(s) END) AS BIGINT) FROM fold JOIN last USING (conv_id) GROUP BY conv_id
    """,
)
def by_stage(spark: SparkSession, sf: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, "chatml")
    result = None
    for stage in ("sft", "ppo"):
        built = E.build_examples(chat, stage, enc, "conv_id", CUTOFF)
        part = built.select(F.lit(stage).alias("stage"), "conv_id", F.size("input_ids").cast("long").alias("n"))
        result = part if result is None else result.unionByName(part)
    return result


@query("PRE-11:pt", SQL["PRE-01"])
def pretraining_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as prompts of the pre-training stage: the blocks of the packing query."""
    docs = documents(spark, sf).select("doc_id", F.array(message("user", F.col("text"))).alias("prompt"))
    enc = E.Encoding(get_template("default"), written(doc_vocab(spark, sf), "vocab"), eos_id=1, has_tools=False)
    packed = E.build_examples(docs, "pt", enc, "doc_id", BLOCK, batch_rows=BATCH_ROWS)
    return packed.select("batch", "block", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join("input_ids", ",")).alias("ids"))


@query("PRE-11:rm", SQL["PRE-05"])
def reward_stage(spark: SparkSession, sf: str) -> DataFrame:
    from corpusflow.sources.registry import DatasetSpec

    aligned = align_alpaca(ranking_rows(spark, sf), DatasetSpec(name="r", history="history"), ["doc_id"])
    enc = E.make_encoding(aligned, "falcon", 100_000, has_tools=False)
    return _joined(E.build_examples(aligned, "rm", enc, "doc_id", PAIR_CUTOFF), ["doc_id"], ["prompt_ids", "chosen_ids", "rejected_ids"])


@query("PRE-11:packed", SQL["PRE-03:efficient_eos"])
def packed_stage(spark: SparkSession, sf: str) -> DataFrame:
    chat, enc = _encoding(spark, sf, "falcon")
    packed = E.build_examples(chat, "sft", enc, "conv_id", BLOCK, sft_packing=True, chunk=id_chunk("conv_id"), batch_rows=BATCH_ROWS)
    return _joined(packed, ["batch", "block"], ["input_ids", "labels"])


PAD_ROWS = 16


@query(
    "PRE-12",
    f"""
    WITH t AS (SELECT doc_id, doc_id // {PAD_ROWS} AS batch, len({tokens_sql('text')}) AS n FROM documents),
    g AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch) / 8.0) * 8 AS INT) AS goal FROM t)
    SELECT doc_id, batch, goal AS n_ids, goal AS n_labels, n AS ones, goal - n AS ignored FROM g
    """,
)
def padded(spark: SparkSession, sf: str) -> DataFrame:
    docs = doc_tokens(spark, sf).withColumn("input_ids", F.transform("tokens", lambda _: F.lit(7)))
    docs = docs.withColumn("attention_mask", E.attention_mask(F.col("input_ids"))).withColumn("labels", F.col("input_ids")).drop("tokens")
    out = E.pad_batch(E.batches(docs, "doc_id", None, PAD_ROWS), "batch", pad_id=0)
    return out.select(
        "doc_id",
        "batch",
        F.size("input_ids").alias("n_ids"),
        F.size("labels").alias("n_labels"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"),
        F.size(F.filter("labels", lambda x: x == IGNORE)).alias("ignored"),
    )


@query(
    "PRE-13",
    f"""
    SELECT doc_id, array_to_string(list_transform(t, lambda x: CASE WHEN x = 3 THEN -100 ELSE x END), ',') AS labels
    FROM (SELECT doc_id, list_transform({tokens_sql('text')}, lambda x: length(x)) AS t FROM documents)
    """,
)
def causal_labels(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform("tokens", lambda t: F.length(t))
    return doc_tokens(spark, sf).select("doc_id", F.array_join(E.lm_labels(ids, 3), ",").alias("labels"))


HISTORY = 120


@query(
    "PRE-14",
    f"""
    WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    sys AS (SELECT conv_id, max(CASE WHEN i = 1 AND role = 'system' THEN text ELSE '' END) AS system, max(role) FILTER (i = n) AS last_role FROM m GROUP BY conv_id),
    body AS (SELECT m.conv_id, i, role, [CASE WHEN role = 'user' THEN '<user>' ELSE '<assistant>' END] || {tokens_sql('text')} AS t FROM m WHERE NOT (i = 1 AND role = 'system')),
    suf AS (SELECT *, sum(len(t)) OVER (PARTITION BY conv_id ORDER BY i DESC) AS left_over, min(i) OVER (PARTITION BY conv_id) AS i0 FROM body),
    starts AS (SELECT s.*, len({tokens_sql('system')}) AS ns FROM suf s JOIN sys USING (conv_id) WHERE role = 'user' OR i = i0),
    begin_at AS (SELECT conv_id, coalesce(min(i) FILTER (left_over <= {HISTORY} - ns), max(i)) AS b FROM starts GROUP BY conv_id),
    kept AS (SELECT sys.conv_id, {tokens_sql('any_value(system)')} || flatten(list(t ORDER BY i)) || CASE WHEN any_value(last_role) <> 'assistant' THEN ['<assistant>'] ELSE [] END AS t
             FROM body JOIN begin_at USING (conv_id) JOIN sys USING (conv_id) WHERE i >= b GROUP BY sys.conv_id)
    SELECT conv_id, least(len(t), {HISTORY}) AS n, md5(array_to_string(t[greatest(len(t) - {HISTORY}, 0) + 1:], ' ')) AS h FROM kept
    """,
)
def history(spark: SparkSession, sf: str) -> DataFrame:
    from corpusflow.operators.align import assemble_turns, extract_system

    chat = assemble_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    system, rest = extract_system(F.col("conversations"), "from", "value", "system", F.lit(""))
    msgs = F.transform(rest, lambda m: F.struct(m["from"].alias("role"), m["value"].alias("content")))
    chat = chat.select("conv_id", system.alias("system"), msgs.alias("messages")).where(F.size("messages") > 0)
    out = E.trim_history(chat, "messages", "system", HISTORY, "whitespace", "<user>", "<assistant>", "input")
    return out.select("conv_id", F.size("input").alias("n"), F.md5(F.array_join("input", " ")).alias("h"))


@query("PRE-14:turns", SQL["PRE-14"])
def history_from_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The same from turn rows, summed from the newest turn back."""
    turns = table(spark, sf, "conversations")
    leads = F.struct((F.col("role") == "system").alias("is_system"), F.when(F.col("role") == "system", F.col("text")).otherwise("").alias("system"))
    heads = turns.groupBy("conv_id").agg(F.min_by(leads, "turn").alias("h"))
    rows = positions(turns, ["conv_id"], ["turn"], id_chunk("turn", 1024), "at").join(heads, "conv_id")
    idx = (F.col("at") - F.col("h.is_system").cast("int")).cast("int")
    messages = rows.select("conv_id", idx.alias("idx"), "role", F.col("text").alias("content"), F.col("h.system").alias("system")).where("idx >= 0")
    out = E.trim_turns(messages, "conv_id", "system", HISTORY, "whitespace", "<user>", "<assistant>", "input")
    return out.select("conv_id", F.size("input").alias("n"), F.md5(F.array_join("input", " ")).alias("h"))


@query(
    "PRE-15",
    f"""
    SELECT doc_id, CASE WHEN pad_at IS NULL OR pad_at = 0 THEN -1 ELSE pad_at - 2 END AS last_valid
    FROM (SELECT doc_id, list_position(list_transform({tokens_sql('text')}, lambda x: length(x)), 9) AS pad_at FROM documents)
    """,
)
def last_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of nine characters stand for padding."""
    return doc_tokens(spark, sf).select("doc_id", E.last_valid_index(F.transform("tokens", lambda t: F.length(t)), 9).alias("last_valid"))


@query(
    "PRE-17",
    f"""
    WITH t AS (SELECT doc_id, md5('42:' || doc_id) AS h, {tokens_sql('text')} AS t FROM documents),
    p AS (SELECT * FROM t WHERE len(t) >= 64 ORDER BY h, doc_id LIMIT 32),
    s AS (SELECT doc_id, t, CASE WHEN len(t) = 64 THEN 0 ELSE CAST(('0x' || substr(h, 17, 8)) AS BIGINT) % (len(t) - 64) END AS start FROM p)
    SELECT doc_id, start, array_to_string(t[start + 1:start + 64], ' ') AS sample FROM s
    """,
)
def crops(spark: SparkSession, sf: str) -> DataFrame:
    out = E.crop_samples(doc_tokens(spark, sf), "doc_id", "tokens", 32, 64, 42)
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.array_join("sample", " ").alias("sample"))


# Mixing --------------------------------------------------------------------------------------------------------------

LANGS = ["en", "fr", "de", "es"]
DATASET_SQL = "ds AS (SELECT doc_id, list_position(['en', 'fr', 'de', 'es'], lang) - 1 AS d, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language as four numbered datasets, those of any other language as a fifth."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    other = docs.where(~F.coalesce(F.col("lang").isin(LANGS), F.lit(False)))
    return M.mix_concat([*[docs.where(F.col("lang") == lang) for lang in LANGS], other]).drop("lang")


def lang_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The same numbering with one scan of the table."""
    number = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    return table(spark, sf, "documents").select("doc_id", number.cast("int").alias("dataset_idx"))


@query("MIX-01", "WITH " + DATASET_SQL + " SELECT coalesce(d, 4) AS dataset_idx, doc_id FROM ds")
def concatenated(spark: SparkSession, sf: str) -> DataFrame:
    return datasets(spark, sf).select("dataset_idx", "doc_id")


@query("MIX-02", "WITH " + DATASET_SQL + " SELECT d AS dataset_idx, doc_id, rn * 4 + d AS slot FROM ds WHERE rn < (SELECT min(n) FROM ds)")
def interleaved_under(spark: SparkSession, sf: str) -> DataFrame:
    return M.interleave_under(lang_numbers(spark, sf), "dataset_idx", "doc_id", id_chunk("doc_id"))


@query(
    "MIX-03",
    "WITH " + DATASET_SQL + """,
    rounds AS (SELECT unnest(range((SELECT max(n) FROM ds))) AS r)
    SELECT d AS dataset_idx, doc_id, r * 4 + d AS slot FROM rounds JOIN ds ON r % n = rn
    """,
)
def interleaved_over(spark: SparkSession, sf: str) -> DataFrame:
    return M.interleave_over(lang_numbers(spark, sf), "dataset_idx", "doc_id", id_chunk("doc_id"))


def _draws_sql(over: bool) -> str:
    end = "max" if over else "min"
    size = "(SELECT count(*) * 40 FROM documents)" if over else "(SELECT count(*) * 10 FROM documents)"
    return (
        "WITH " + DATASET_SQL + f""",
        u AS (SELECT s AS slot, CAST(('0x' || substr(md5('7:' || s), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM range({size}) t(s)),
        src AS (SELECT slot, CASE WHEN u < 0.4 THEN 0 WHEN u < 0.7 THEN 1 WHEN u < 0.9 THEN 2 ELSE 3 END AS d FROM u),
        k AS (SELECT slot, d, row_number() OVER (PARTITION BY d ORDER BY slot) - 1 AS k FROM src),
        sizes AS (SELECT DISTINCT d, n FROM ds),
        stop AS (SELECT {end}(slot) AS slot FROM k JOIN sizes USING (d) WHERE k = n - 1)
        SELECT k.slot, k.d AS dataset_idx, ds.doc_id FROM k JOIN sizes USING (d) JOIN ds ON ds.d = k.d AND ds.rn = k.k % sizes.n WHERE k.slot <= (SELECT slot FROM stop)
        """
    )


@query("MIX-04", _draws_sql(False))
def interleaved_probs(spark: SparkSession, sf: str) -> DataFrame:
    return M.interleave_probs(lang_numbers(spark, sf), "dataset_idx", "doc_id", id_chunk("doc_id"), [0.4, 0.3, 0.2, 0.1], 7)


@query("MIX-04:over", _draws_sql(True))
def interleaved_probs_over(spark: SparkSession, sf: str) -> DataFrame:
    return M.interleave_probs(lang_numbers(spark, sf), "dataset_idx", "doc_id", id_chunk("doc_id"), [0.4, 0.3, 0.2, 0.1], 7, over=True)


@query(
    "MIX-05",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= (SELECT ceil(count(*) * 0.1) FROM documents) THEN 'test' ELSE 'train' END AS split FROM documents",
)
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return M.train_test_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, 42)


@query(
    "MIX-06",
    "SELECT 'take' AS part, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) UNION ALL (SELECT 'skip', doc_id FROM documents ORDER BY doc_id OFFSET 100)",
)
def head_and_tail(spark: SparkSession, sf: str) -> DataFrame:
    docs, chunk = table(spark, sf, "documents").select("doc_id"), id_chunk("doc_id")
    head = M.take(docs, "doc_id", 100, chunk).select(F.lit("take").alias("part"), "doc_id")
    return head.unionByName(M.skip(docs, "doc_id", 100, chunk).select(F.lit("skip").alias("part"), "doc_id"))


@query(
    "MIX-07",
    "SELECT doc_id, 256 * (doc_id // 256) + row_number() OVER (PARTITION BY doc_id // 256 ORDER BY md5('42:' || doc_id), doc_id) - 1 AS slot FROM documents",
)
def shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return M.buffered_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", "doc_id", 42, 256)


@query("MIX-07:full", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS slot FROM documents")
def shuffled_whole(spark: SparkSession, sf: str) -> DataFrame:
    return M.full_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


@query("MIX-08", "SELECT doc_id, rn AS sample, rn % 4 AS worker FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) WHERE rn < 128")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return M.calibration_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 128, 4, id_chunk("doc_id"))



@query("SNK-05", f"SELECT doc_id, len({tokens_sql('text')}) AS n, 'documents' AS kind FROM documents")
def saved_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Tokenised documents written as examples and read back."""
    path = scratch_path(spark, "examples")
    write_examples(doc_tokens(spark, sf).select("doc_id", F.size("tokens").alias("n")), path)
    return spark.read.schema("doc_id long, n int").parquet(path).withColumn("kind", F.lit("documents"))


# Datasets by name ------------------------------------------------------------------------------------------------------

_LANGUAGES = ("en", "fr")
_PREPARED_SQL = f"""
    WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS d, len({tokens_sql('text')}) AS n FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY d) AS size FROM t)
"""


def _folders(spark: SparkSession, sf: str) -> tuple[str, list]:
    """Three datasets as folders of parquet files: two languages, one below a subset folder, and all other documents."""
    from corpusflow.sources.registry import DatasetSpec

    root = scratch_path(spark, "datasets")
    name = F.when(F.col("lang").isin(*_LANGUAGES), F.col("lang")).otherwise("rest")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("instruction"), F.lit("").alias("input"), F.lit("seen").alias("output"), name.alias("name"))
    specs = [DatasetSpec(name=p, location=p, subset="main" if p == "fr" else None) for p in (*_LANGUAGES, "rest")]
    for spec in specs:
        docs.where(F.col("name") == spec.name).drop("name").write.parquet("/".join([root, spec.name, *([spec.subset] if spec.subset else [])]))
    return root, specs


@query("SRC-04:prepare", _PREPARED_SQL + "SELECT rn + (SELECT count(*) FROM t WHERE t.d < r.d) AS example, CAST(n + 4 AS BIGINT) AS n_ids FROM r")
def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of files by name, aligned, put one after another and encoded whole."""
    root, specs = _folders(spark, sf)
    out = prepare(spark, specs, root, "sft", "default", "doc_id", id_chunk("doc_id"), cutoff=None, cache_path=f"{root}/cache")
    return out.select("example", F.size("input_ids").cast("long").alias("n_ids"))


@query("MIX-01:strategy", _PREPARED_SQL + "SELECT rn * 3 + d AS example, CAST(n + 4 AS BIGINT) AS n_ids FROM r WHERE rn < (SELECT min(size) FROM r)")
def prepared_by_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """The same datasets dealt in turn until the first ends."""
    root, specs = _folders(spark, sf)
    out = prepare(spark, specs, root, "sft", "default", "doc_id", id_chunk("doc_id"), cutoff=None, strategy="interleave_under")
    return out.select("example", F.size("input_ids").cast("long").alias("n_ids"))


@query(
    "MIX-04:strategy",
    _PREPARED_SQL + """,
    u AS (SELECT i AS slot, ('0x' || substr(md5('42:' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM range(0, 3 * (SELECT count(*) FROM t)) x(i)),
    k AS (SELECT slot, d, row_number() OVER (PARTITION BY d ORDER BY slot) - 1 AS rn FROM (SELECT slot, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN 1 ELSE 2 END AS d FROM u)),
    e AS (SELECT min(slot) AS stop FROM k JOIN r USING (d, rn) WHERE rn = size - 1)
    SELECT slot AS example, CAST(n + 4 AS BIGINT) AS n_ids FROM k JOIN r USING (d, rn) WHERE slot <= (SELECT stop FROM e)
    """,
)
def prepared_by_chance(spark: SparkSession, sf: str) -> DataFrame:
    """The same datasets drawn with probabilities until the first ends."""
    root, specs = _folders(spark, sf)
    out = prepare(
        spark, specs, root, "sft", "default", "doc_id", id_chunk("doc_id"), cutoff=None, strategy="interleave_under", probs=[0.5, 0.25, 0.25]
    )
    return out.select("example", F.size("input_ids").cast("long").alias("n_ids"))
