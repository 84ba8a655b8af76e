"""Queries: layer similarity and selection, bounded streams, token losses, vectors and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.strings import layer_of
from corpusflow.functions.tokenizers import whitespace
from corpusflow.operators import reports as P
from corpusflow.operators import retention as K
from corpusflow.operators import scoring as C
from corpusflow.operators import selection as S
from corpusflow.operators import similarity as Y
from corpusflow.operators import vectors as V
from corpusflow.operators.ordering import id_chunk, positions, time_chunk
from corpusflow.plans.catalog import BLOCK_SQL, N_LAYERS, RESIDUAL_SQL, STATES_SQL, documents, layer_states, query, table, tokens_sql
from corpusflow.session import written


def block_scores(spark: SparkSession, sf: str) -> DataFrame:
    return written(Y.block_similarity(layer_states(spark, sf)).drop("target"), "block-scores")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Similarity ----------------------------------------------------------------------------------------------------------


@query("AGG-01", "WITH " + RESIDUAL_SQL + "SELECT run_id, layer, round(score, 6) AS score FROM rsim")
def residual_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _round(Y.layer_similarity(layer_states(spark, sf), drop_norm=True).drop("target"), "score")


@query("AGG-01:norm", "WITH " + BLOCK_SQL + "SELECT run_id, layer, round(score, 6) AS score FROM sim WHERE layer <> 2")
def norm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised inputs against the module's output; layer 2 was dropped before."""
    states = layer_states(spark, sf)
    gone = states.select("run_id", "target", "layer").where(F.col("layer") == 2).distinct()
    return _round(Y.layer_similarity(states, drop_norm=False, skipped=gone).drop("target"), "score")


@query("AGG-02", "WITH " + BLOCK_SQL + "SELECT run_id, layer, round(score, 6) AS score FROM sim")
def block_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return _round(Y.block_similarity(layer_states(spark, sf)).drop("target"), "score")


GAP_SQL = (
    STATES_SQL
    + f""",
every AS (SELECT run_id, vec_id, layer, h_in AS h FROM states UNION ALL SELECT run_id, vec_id, layer + 1, h_out FROM states WHERE layer = {N_LAYERS - 1}),
gaps AS (SELECT a.run_id, a.layer, CAST(b.layer - a.layer AS INT) AS gap, avg(list_cosine_similarity(a.h, b.h)) AS score
         FROM every a JOIN every b ON a.vec_id = b.vec_id AND a.layer < b.layer GROUP BY ALL)
"""
)


@query("AGG-03", "WITH " + GAP_SQL + "SELECT run_id, layer, gap, round(score, 6) AS score FROM gaps")
def gap_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return _round(Y.gap_similarity(layer_states(spark, sf)), "score")


@query(
    "JOIN-05",
    "WITH " + STATES_SQL + f"SELECT run_id, sample_id, count(*) AS tokens, {N_LAYERS + 1} AS states, {N_LAYERS * (N_LAYERS + 1) // 2} AS pairs FROM states WHERE layer = 0 GROUP BY ALL",
)
def pairs_per_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The stacks that pairs of layers are formed in: one row per token, no pair of rows is ever joined."""
    stack = Y.layer_stack(layer_states(spark, sf))
    n = F.size("states")
    return stack.groupBy("run_id", "sample_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.max(n).alias("states"), F.max((n * (n - 1) / 2).cast("int")).alias("pairs")
    )


@query("AGG-04", "WITH " + BLOCK_SQL + """
    SELECT run_id, layer, round(avg(m), 6) AS score
    FROM (SELECT run_id, layer, sample_id % 4 AS worker, avg(m) AS m FROM per_sample GROUP BY ALL) GROUP BY ALL""")
def merged_partials(spark: SparkSession, sf: str) -> DataFrame:
    """Samples dealt to four workers; their means count equally."""
    states = layer_states(spark, sf).withColumn("target", (F.col("sample_id") % 4).cast("string"))
    return _round(Y.merge_partials(Y.block_similarity(states).withColumn("target", F.lit("attn"))).drop("target"), "score")


# Selection -----------------------------------------------------------------------------------------------------------

RANKED_SQL = BLOCK_SQL + ", ranked AS (SELECT run_id, layer, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, layer) AS rank FROM sim)"


@query("TOP-01", "WITH " + RANKED_SQL + "SELECT run_id, layer, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3")
def drop_list(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.select_drop(block_scores(spark, sf), 3, ["run_id"]), "score")


JOINT_SQL = (
    RESIDUAL_SQL
    + ", "
    + BLOCK_SQL[len(STATES_SQL) + 1 :].lstrip()
    + f""",
joint AS (SELECT run_id, layer, score FROM sim UNION ALL SELECT run_id, layer + {N_LAYERS}, score FROM rsim),
jranked AS (SELECT run_id, layer, score, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, layer) AS rank FROM joint)
"""
)


def _joint(spark: SparkSession, sf: str) -> DataFrame:
    states = layer_states(spark, sf)
    return S.select_drop_joint(Y.block_similarity(states), Y.layer_similarity(states), 6, N_LAYERS)


@query("TOP-02", "WITH " + JOINT_SQL + "SELECT run_id, layer, round(score, 6) AS score, rank FROM jranked WHERE rank <= 6")
def joint_drop_list(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_joint(spark, sf), "score")


def _block_sql(gap: int) -> str:
    return (
        "WITH " + GAP_SQL + f""",
        best AS (SELECT run_id, arg_max(layer, score) AS b, max(score) AS score FROM gaps WHERE gap = {gap} GROUP BY run_id)
        SELECT run_id, round(score, 6) AS score, b + k AS layer FROM best, range(3) t(k)
        """
    )


@query("TOP-03", _block_sql(4))
def block_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.select_block(Y.gap_similarity(layer_states(spark, sf)), 3), "score")


@query("TOP-03:exact", _block_sql(3))
def block_drop_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.select_block(Y.gap_similarity(layer_states(spark, sf)), 3, "exact"), "score")


@query(
    "TOP-04",
    "WITH " + BLOCK_SQL + """, m AS (SELECT *, max(score) OVER (PARTITION BY run_id) AS best FROM sim)
    SELECT run_id, round(max(best), 6) AS score, min(layer) AS layer FROM m WHERE abs(score - best) < 0.02 GROUP BY run_id""",
)
def tolerant_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.argmax_with_tolerance(block_scores(spark, sf), 0.02, ["run_id"]), "score")


@query(
    "TOP-05",
    "WITH RECURSIVE " + BLOCK_SQL + """,
    start AS (SELECT run_id, list(score ORDER BY layer) AS s FROM sim GROUP BY run_id),
    fold AS (
      SELECT run_id, 0 AS round, list_max(s) AS score, list_position(list_transform(s, lambda x: abs(x - list_max(s)) < 0.001), true) AS at_pos, s FROM start
      UNION ALL
      SELECT run_id, round + 1, list_max(t), list_position(list_transform(t, lambda x: abs(x - list_max(t)) < 0.001), true), t
      FROM (SELECT run_id, round, list_transform(s, lambda x, i: CASE WHEN i = at_pos THEN 0.0 ELSE x END) AS t FROM fold WHERE round < 3))
    SELECT run_id, round, CAST(at_pos - 1 AS INT) AS layer, round(score, 6) AS score FROM fold
    """,
)
def greedy(spark: SparkSession, sf: str) -> DataFrame:
    return _round(S.greedy_top_k(block_scores(spark, sf), 4, 0.001, ["run_id"]), "score")


@query(
    "TOP-06",
    "WITH " + RANKED_SQL + "SELECT run_id, layer, round(score, 6) AS score, CASE WHEN rank <= 2 THEN 1 ELSE 2 END AS epoch FROM ranked WHERE rank <= 4",
)
def iterative(spark: SparkSession, sf: str) -> DataFrame:
    """Two epochs of two layers; scores of the remaining layers do not depend on the dropped ones here."""
    states = layer_states(spark, sf)
    score = lambda gone: Y.layer_similarity(states, drop_norm=False, skipped=gone)
    out = S.iterative_drop(score, 2, 2)
    return _round(out.select("run_id", "layer", "score", "epoch"), "score")


@query("JOIN-03", "WITH " + RANKED_SQL + "SELECT run_id, layer FROM ranked WHERE rank > 3")
def kept_layers(spark: SparkSession, sf: str) -> DataFrame:
    scores = block_scores(spark, sf)
    return S.complement(scores.select("run_id", "layer"), S.select_drop(scores, 3, ["run_id"]), ["run_id", "layer"])


@query(
    "SET-01",
    "WITH " + JOINT_SQL + f"SELECT run_id, CASE WHEN layer >= {N_LAYERS} THEN 'mlp' ELSE 'attn' END AS module, layer % {N_LAYERS} AS layer FROM jranked WHERE rank <= 6",
)
def joint_split(spark: SparkSession, sf: str) -> DataFrame:
    return S.split_joint(_joint(spark, sf), N_LAYERS).select("run_id", "module", "layer")


@query("SET-02", "WITH " + RANKED_SQL + "SELECT run_id, layer FROM ranked WHERE rank <= 3 UNION SELECT run_id, layer FROM ranked WHERE layer IN (0, 5)")
def merged_lists(spark: SparkSession, sf: str) -> DataFrame:
    scores = block_scores(spark, sf)
    return S.merge_drop_lists(scores.where(F.col("layer").isin(0, 5)), S.select_drop(scores, 3, ["run_id"]))


@query(
    "SET-03",
    """
    SELECT o_orderkey, array_to_string(list_transform(range(8), lambda i: CAST(coalesce(list_contains(ids, CAST(i AS INT)), false) AS INT)), '') AS from_ids,
           array_to_string(list_transform(range(8), lambda i: CAST(coalesce(flags[i + 1], false) AS INT)), '') AS from_flags
    FROM (SELECT o_orderkey, list(l_linenumber) FILTER (l_returnflag = 'R') AS ids, list(l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS flags
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
    """,
)
def drop_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of an order as layers: returned ones are listed by number and as flags of any length."""
    li = table(spark, sf, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("ids"),
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") == "R").alias("r")))).alias("f"),
    )
    rows = table(spark, sf, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")
    return rows.select(
        "o_orderkey",
        show(S.normalise_drop_list(F.col("ids"), 8, True)).alias("from_ids"),
        show(S.normalise_drop_list(F.col("f").getField("r"), 8, False)).alias("from_flags"),
    )


@query("SET-04", "WITH " + RANKED_SQL + "SELECT run_id, layer, row_number() OVER (PARTITION BY run_id ORDER BY layer) - 1 AS new_layer FROM ranked WHERE rank > 3")
def reindexed(spark: SparkSession, sf: str) -> DataFrame:
    scores = block_scores(spark, sf)
    kept = S.complement(scores.select("run_id", "layer"), S.select_drop(scores, 3, ["run_id"]), ["run_id", "layer"])
    return S.reindex_layers(kept)


@query(
    "SET-05",
    "WITH " + RANKED_SQL + "SELECT run_id, layer, row_number() OVER (PARTITION BY run_id ORDER BY layer) - 1 AS slot, count(*) OVER (PARTITION BY run_id) AS n_slots FROM ranked WHERE rank > 3",
)
def slots(spark: SparkSession, sf: str) -> DataFrame:
    scores = block_scores(spark, sf)
    gone = S.select_drop(scores, 3, ["run_id"]).select("run_id", "layer", F.lit(True).alias("drop_attn"))
    plan = scores.select("run_id", "layer").join(gone, ["run_id", "layer"], "left").withColumn("drop_attn", F.coalesce("drop_attn", F.lit(False)))
    return S.active_slots(plan).drop("drop_attn")


# Bounded streams -----------------------------------------------------------------------------------------------------

DAY = 86_400
EVENTS_SQL = """ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("WIN-03", "WITH " + EVENTS_SQL + "SELECT user_id, event_id, pos, n AS stream_len FROM ev WHERE n <= 24 OR pos < 4 OR pos >= n - 20")
def retained(spark: SparkSession, sf: str) -> DataFrame:
    kept = K.retain_sink_recent(events(spark, sf), ["user_id"], ["ts", "event_id"], 4, 20, time_chunk("ts", DAY))
    return kept.select("user_id", "event_id", "pos", "stream_len")


@query("WIN-04", "WITH " + EVENTS_SQL + "SELECT user_id, event_id, pos FROM ev WHERE n + 3 <= 24 OR pos < 4 OR pos >= n - 17")
def retained_for_space(spark: SparkSession, sf: str) -> DataFrame:
    kept = K.retain_for_space(events(spark, sf), ["user_id"], ["ts", "event_id"], 4, 20, 3, time_chunk("ts", DAY))
    return kept.select("user_id", "event_id", "pos")


@query("WIN-05", "WITH " + EVENTS_SQL + "SELECT user_id, event_id, pos FROM ev WHERE pos < 4 OR pos >= 10 OR event_type = 'error'")
def evicted(spark: SparkSession, sf: str) -> DataFrame:
    """Positions 4 to 9 evicted; error events stand for layers without a cache entry."""
    placed = positions(events(spark, sf), ["user_id"], ["ts", "event_id"], time_chunk("ts", DAY))
    placed = placed.withColumn("entry", F.when(F.col("event_type") != "error", F.col("value")))
    return K.evict_range(placed, 4, 10, "pos", "entry").select("user_id", "event_id", "pos")


@query(
    "WIN-06",
    "WITH " + EVENTS_SQL + """
    SELECT user_id, event_id, CASE WHEN pos < 4 THEN pos ELSE 4 + (pos - 4) % 20 END AS steady,
           CASE WHEN n <= 24 OR pos < 4 THEN pos ELSE pos - (n - 20) + 4 END AS live, least(n, 24) AS next_pos
    FROM ev WHERE n <= 24 OR pos < 4 OR pos >= n - 20
    """,
)
def cache_slots(spark: SparkSession, sf: str) -> DataFrame:
    kept = K.retain_sink_recent(events(spark, sf), ["user_id"], ["ts", "event_id"], 4, 20, time_chunk("ts", DAY))
    live = K.live_positions(kept, ["user_id"], 4, 20)
    return live.select("user_id", "event_id", K.cache_position(F.col("pos"), 4, 20).alias("steady"), F.col("cache_pos").alias("live"), "next_pos")


@query(
    "JOIN-04",
    "WITH " + EVENTS_SQL + "SELECT a.user_id, a.pos, b.pos AS key_pos FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.pos <= a.pos AND (b.pos < 2 OR b.pos >= a.pos - 4 + 1)",
)
def visible_keys(spark: SparkSession, sf: str) -> DataFrame:
    placed = positions(events(spark, sf), ["user_id"], ["ts", "event_id"], time_chunk("ts", DAY))
    return K.visible_pairs(placed.select("user_id", "pos"), "pos", 2, 4)


@query(
    "WIN-07",
    "WITH " + EVENTS_SQL + "SELECT a.user_id, a.pos, count(*) AS visible FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.pos <= a.pos AND (b.pos < 4 OR b.pos >= a.pos - 8 + 1) GROUP BY ALL",
)
def visible_counts(spark: SparkSession, sf: str) -> DataFrame:
    placed = positions(events(spark, sf), ["user_id"], ["ts", "event_id"], time_chunk("ts", DAY))
    return placed.select("user_id", "pos", K.visible_count(F.col("pos"), 4, 8).cast("long").alias("visible"))


@query("WIN-08", "WITH " + EVENTS_SQL + "SELECT user_id, event_id, pos FROM ev WHERE (pos + 1) % 10 = 0")
def sampled(spark: SparkSession, sf: str) -> DataFrame:
    return K.sample_every(events(spark, sf), ["user_id"], ["ts", "event_id"], 10, time_chunk("ts", DAY)).select("user_id", "event_id", "pos")


STEPS_SQL = """steps AS (SELECT user_id, event_id, value, event_type, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0, 6) AS seconds, row_number() OVER w AS rn
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return C.step_durations(events(spark, sf), ["user_id"], ["ts", "event_id"], "ts", time_chunk("ts", DAY))


@query("WIN-09", "WITH " + STEPS_SQL + "SELECT user_id, event_id, seconds, CASE WHEN rn = 2 THEN 'prefill' ELSE 'decode' END AS phase FROM steps WHERE rn > 1")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    return _round(steps(spark, sf), "seconds").select("user_id", "event_id", "seconds", "phase")


# Token losses --------------------------------------------------------------------------------------------------------


def doc_stream(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", whitespace(F.col("text")).alias("tokens"))
    return C.token_stream(docs, "doc_id", "tokens")


TOKENS_SQL = f"tok AS (SELECT doc_id, CAST(unnest(range(len(t))) AS BIGINT) AS pos, unnest(t) AS token FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents))"


@query(
    "WIN-01",
    "WITH " + TOKENS_SQL + "SELECT doc_id, count(*) AS n, md5(string_agg(token || '>' || label, ' ' ORDER BY pos)) AS h FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS label FROM tok) WHERE label IS NOT NULL GROUP BY doc_id",
)
def next_tokens(spark: SparkSession, sf: str) -> DataFrame:
    pairs = C.next_token_label(doc_stream(spark, sf), "doc_id", "pos", "token", 4096)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("token", F.lit(">"), "label").alias("t")))), lambda x: x["t"]), " ")
    return pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.md5(text).alias("h"))


@query(
    "WIN-01:arrays",
    "WITH " + TOKENS_SQL + "SELECT token, label, count(*) AS n FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS label FROM tok) WHERE label IS NOT NULL GROUP BY ALL",
)
def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", whitespace(F.col("text")).alias("tokens"))
    return C.next_token_pairs(docs, "doc_id", "tokens").groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))


START, RECENT = 4, 32
DENSE_SQL = TOKENS_SQL + """,
vocab AS (SELECT count(DISTINCT token) AS v FROM tok),
dense AS (SELECT doc_id, pos, -ln((row_number() OVER (PARTITION BY doc_id, token ORDER BY pos) - 1 + 1.0) / (pos + 1.0 * v)) AS nll FROM tok, vocab)
"""
BOUNDED_SQL = TOKENS_SQL + f""",
vocab AS (SELECT count(DISTINCT token) AS v FROM tok),
near AS (SELECT *, count(*) OVER (PARTITION BY doc_id, token ORDER BY pos RANGE BETWEEN {RECENT + 1} PRECEDING AND 1 PRECEDING) AS c FROM tok),
sinks AS (SELECT doc_id, token, list(pos) AS at_pos FROM tok WHERE pos < {START} GROUP BY ALL),
bounded AS (SELECT n.doc_id, n.pos, -ln((c + len(list_filter(coalesce(s.at_pos, []), lambda x: x < n.pos - {RECENT + 1})) + 1.0)
              / (least(n.pos, {RECENT + 1}) + greatest(least({START}, n.pos - {RECENT + 1}), 0) + 1.0 * v)) AS nll
            FROM near n LEFT JOIN sinks s ON s.doc_id = n.doc_id AND s.token = n.token, vocab)
"""


def scored(spark: SparkSession, sf: str, bounded: bool) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", whitespace(F.col("text")).alias("tokens"))
    v = C.token_stream(docs, "doc_id", "tokens").agg(F.count_distinct("token")).scalar()
    if bounded:
        return C.window_scored_arrays(docs, "doc_id", "tokens", v, START, RECENT)
    return C.window_scored_arrays(docs, "doc_id", "tokens", v)


@query(
    "WIN-12",
    "WITH " + BOUNDED_SQL + "SELECT doc_id, round(exp(avg(nll)), 4) AS ppl, round(avg(nll), 6) AS mean_nll, count(*) AS num_eval_tokens FROM bounded WHERE pos > 0 GROUP BY doc_id",
)
def bounded_ppl(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_round(C.perplexity(scored(spark, sf, True), ["doc_id"]), "mean_nll"), "ppl", digits=4)


@query(
    "WIN-12:dense",
    "WITH " + DENSE_SQL + "SELECT doc_id, round(exp(avg(nll)), 4) AS ppl, round(avg(nll), 6) AS mean_nll, count(*) AS num_eval_tokens FROM dense WHERE pos > 0 GROUP BY doc_id",
)
def dense_ppl(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_round(C.perplexity(scored(spark, sf, False), ["doc_id"]), "mean_nll"), "ppl", digits=4)


@query(
    "WIN-10",
    "WITH " + EVENTS_SQL + "SELECT user_id, event_id, round(exp(value / 100), 6) AS step_ppl, round(exp(avg(value / 100) OVER (PARTITION BY user_id ORDER BY pos)), 6) AS running_ppl FROM ev",
)
def running_ppl(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).withColumn("nll", F.col("value") / 100)
    out = C.running_perplexity(ev, ["user_id"], ["ts", "event_id"], "nll", time_chunk("ts", DAY))
    return _round(out, "step_ppl", "running_ppl").select("user_id", "event_id", "step_ppl", "running_ppl")


LOSS_SQL = """x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
loss AS (SELECT vec_id, label, ln(list_sum(list_transform(v, lambda e: exp(e)))) - v[label + 1] AS nll FROM x)"""


@query("AGG-05", "WITH " + LOSS_SQL + "SELECT vec_id, round(nll, 6) AS nll FROM loss")
def losses(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select("vec_id", F.round(V.token_nll("embedding", "label"), 6).alias("nll"))


@query(
    "AGG-06",
    "WITH " + LOSS_SQL + """, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM loss)
    SELECT label, round(exp(avg(nll)), 4) AS ppl, count(*) AS num_eval_tokens FROM placed WHERE pos < 100 GROUP BY label""",
)
def first_n_ppl(spark: SparkSession, sf: str) -> DataFrame:
    """Perplexity over the first 100 recorded losses of each stream."""
    losses = table(spark, sf, "embeddings").select("vec_id", "label", V.token_nll("embedding", "label").alias("nll"))
    rows = positions(losses, ["label"], ["vec_id"], id_chunk("vec_id"), "step")
    return _round(C.perplexity(rows, ["label"], pos="step", first_n=100).drop("mean_nll"), "ppl", digits=4)


# Vectors -------------------------------------------------------------------------------------------------------------

HEADS, KV_HEADS, TOP_K = 8, 4, 4


@query(
    "AGG-16",
    f"""
    WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
    g AS (SELECT vec_id, p // 16 AS head, p % 8 AS d, avg(x) AS x FROM e GROUP BY ALL)
    SELECT vec_id, string_agg(printf('%.5f', x + 0.0), ',' ORDER BY head, d) AS pooled FROM g GROUP BY vec_id
    """,
)
def pooled(spark: SparkSession, sf: str) -> DataFrame:
    out = V.group_mean_pool(table(spark, sf, "embeddings"), "embedding", HEADS, KV_HEADS)
    return out.select("vec_id", F.array_join(F.transform("pooled", lambda x: F.format_string("%.5f", x)), ",").alias("pooled"))


SOFTMAX_SQL = """x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT vec_id, label, unnest(v) AS s, generate_subscripts(v, 1) - 1 AS expert FROM x),
sm AS (SELECT vec_id, label, expert, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS score FROM p),
top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, expert) AS rk FROM sm QUALIFY rk <= 4)"""


@query(
    "AGG-17",
    "WITH " + SOFTMAX_SQL + "SELECT vec_id, CAST(expert AS INT) AS expert, round(score / (sum(score) OVER (PARTITION BY vec_id) + 1e-20), 6) AS weight FROM top",
)
def routes(spark: SparkSession, sf: str) -> DataFrame:
    out = V.topk_routing(table(spark, sf, "embeddings"), "embedding", TOP_K)
    rows = out.select("vec_id", F.explode(F.arrays_zip("route.experts", "route.weights")).alias("r"))
    return rows.select("vec_id", F.col("r.experts").alias("expert"), F.round("r.weights", 6).alias("weight"))


def _balance_sql(group: str) -> str:
    return (
        "WITH " + SOFTMAX_SQL + f""",
        means AS (SELECT {group} AS g, expert, avg(score) AS m FROM sm GROUP BY ALL),
        picks AS (SELECT {group} AS g, expert, count(*) AS c FROM top GROUP BY ALL),
        sizes AS (SELECT {group} AS g, count(DISTINCT vec_id) AS n FROM sm GROUP BY ALL)
        SELECT round(avg(l), 6) AS aux_loss FROM (
          SELECT g, 0.01 * sum(m * coalesce(c, 0) / (n * {TOP_K})) * count(*) AS l FROM means LEFT JOIN picks USING (g, expert) JOIN sizes USING (g) GROUP BY g)
        """
    )


@query("AGG-18", _balance_sql("0"))
def balance(spark: SparkSession, sf: str) -> DataFrame:
    return _round(V.load_balance(table(spark, sf, "embeddings"), "embedding", TOP_K, 0.01), "aux_loss")


@query("AGG-18:sequence", _balance_sql("label"))
def balance_by_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return _round(V.load_balance(table(spark, sf, "embeddings"), "embedding", TOP_K, 0.01, "label"), "aux_loss")


@query(
    "AGG-19",
    "WITH " + SOFTMAX_SQL + "SELECT CAST(expert AS INT) AS expert, count(*) AS n_tokens, CAST(sum(count(*)) OVER (ORDER BY expert) AS BIGINT) AS end_offset FROM top GROUP BY expert",
)
def expert_load(spark: SparkSession, sf: str) -> DataFrame:
    return V.tokens_per_expert(V.topk_routing(table(spark, sf, "embeddings"), "embedding", TOP_K))


@query(
    "AGG-21",
    """
    WITH r AS (SELECT lang, ln(n_chars + 1) - 5 AS s, CAST(quality AS DOUBLE) AS t FROM documents JOIN labels USING (doc_id))
    SELECT lang, 'regression' AS kind, round(avg((s - t) * (s - t)), 6) AS loss FROM r GROUP BY lang
    UNION ALL SELECT lang, 'multi_label', round(avg(greatest(s, 0) - s * t + ln(1 + exp(-abs(s)))), 6) FROM r GROUP BY lang
    UNION ALL SELECT CAST(label AS VARCHAR), 'single_label', round(avg(nll), 6) FROM (
      SELECT label, ln(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda e: exp(e)))) - CAST(embedding AS DOUBLE[])[label + 1] AS nll FROM embeddings) GROUP BY label
    """,
)
def score_losses(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.ln(F.col("n_chars") + 1.0) - 5).alias("s"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("t")), "doc_id")
    parts = [
        V.score_loss(rows, kind, F.col("s"), F.col("t"), ["lang"]).withColumn("kind", F.lit(kind)) for kind in ("regression", "multi_label")
    ]
    emb = table(spark, sf, "embeddings").withColumn("lang", F.col("label").cast("string"))
    parts.append(V.score_loss(emb, "single_label", F.col("embedding"), F.col("label"), ["lang"]).withColumn("kind", F.lit("single_label")))
    return _round(parts[0].unionByName(parts[1]).unionByName(parts[2]), "loss")


@query(
    "JOIN-02",
    "SELECT p_partkey, CASE WHEN u.price IS NOT NULL THEN u.price ELSE p_retailprice END AS value FROM part LEFT JOIN (SELECT l_partkey, round(max(l_extendedprice), 2) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) u ON u.l_partkey = p_partkey",
)
def updated_prices(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    new = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.max("l_extendedprice"), 2).alias("value"))
    return V.upsert_params(base, new, "p_partkey", "value")


@query(
    "AGG-23",
    "SELECT round(max(abs(p_retailprice - (p_retailprice + p_size / 1000.0))), 6) AS max_diff, 0 AS unmatched, false AS equal FROM part",
)
def difference(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    b = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") + F.col("p_size") / 1000.0).alias("v"))
    return _round(V.max_abs_diff(a, b, ["p_partkey"], "v", 1e-5), "max_diff")


# Reports -------------------------------------------------------------------------------------------------------------

# Benchmark tasks and their numbers of shots.
GRID_TASKS = [("boolq", 0), ("rte", 0), ("openbookqa", 0), ("piqa", 0), ("mmlu", 5), ("winogrande", 5), ("gsm8k", 5), ("hellaswag", 10), ("arc_challenge", 25)]


@query(
    "JOIN-07",
    "SELECT DISTINCT p_brand AS model, module, drop_n, task, n_shot FROM part, (VALUES ('mlp'), ('attn'), ('block')) a(module), (VALUES (4), (8)) b(drop_n), (VALUES "
    + ", ".join(f"('{t}', {s})" for t, s in GRID_TASKS)
    + ") c(task, n_shot)",
)
def grid(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "part").select(F.col("p_brand").alias("model")).distinct()
    return P.experiment_grid(models, ["mlp", "attn", "block"], [4, 8], [t for t, _ in GRID_TASKS], [s for _, s in GRID_TASKS])


@query(
    "JOIN-08",
    "SELECT source AS metric, round(avg(n_chars) FILTER (lang = 'en'), 6) AS value_a, round(avg(n_chars) FILTER (lang = 'es'), 6) AS value_b FROM documents WHERE lang IN ('en', 'es') GROUP BY source",
)
def compared(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").groupBy(F.col("lang").alias("run_id"), F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value"))
    return _round(P.compare_runs(m, "en", "es"), "value_a", "value_b")


@query(
    "AGG-07",
    """
    SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag <> 'R') AS active_layers, CAST(coalesce(sum(2 * 8 * 128 * 4096 * 2) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS bytes,
           coalesce(sum(2 * 8 * 128 * 4096 * 2) FILTER (l_returnflag <> 'R'), 0) / 1048576.0 AS mib
    FROM lineitem GROUP BY l_orderkey
    """,
)
def footprint(spark: SparkSession, sf: str) -> DataFrame:
    plan = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_returnflag") == "R").alias("drop_attn"))
    return P.kv_footprint(plan, ["run_id"], F.lit(8), F.lit(128), F.lit(4096))


@query(
    "AGG-08",
    "WITH " + STEPS_SQL + "SELECT event_type, round(sum(value) / sum(seconds), 8) AS tokens_per_s, round(max(value) / avg(seconds), 8) AS decode_per_s FROM steps WHERE rn > 1 GROUP BY event_type",
)
def rates(spark: SparkSession, sf: str) -> DataFrame:
    return _round(P.throughput(steps(spark, sf), ["event_type"], "value", "seconds"), "tokens_per_s", "decode_per_s", digits=8)


@query(
    "AGG-09",
    "WITH " + STEPS_SQL + """
    SELECT user_id, CAST(round(max(2048 / (seconds / 3600)) FILTER (rn = 2) * 4, 2) AS VARCHAR) AS prefill_tokens_s,
           CAST(round(1 / median(seconds / 3600) FILTER (rn > 2) * 4, 2) AS VARCHAR) AS decode_tokens_s
    FROM steps WHERE rn > 1 GROUP BY user_id
    """,
)
def speeds(spark: SparkSession, sf: str) -> DataFrame:
    rows = steps(spark, sf).withColumn("hours", F.col("seconds") / 3600)
    return P.speed_summary(rows, ["user_id"], "hours", "phase", F.lit(2048), 4)


@query(
    "AGG-10",
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, count(*) AS runs FROM lineitem GROUP BY ALL",
)
def averages(spark: SparkSession, sf: str) -> DataFrame:
    out = P.average_runs(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return _round(_round(out, "l_quantity"), "l_extendedprice", digits=4)


@query(
    "AGG-11",
    "SELECT event_type, max(value) AS peak_mib, min(value) AS weights_mib, round(max(value) - min(value), 6) AS cache_mib FROM events GROUP BY event_type",
)
def peaks(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    weights = ev.groupBy("event_type").agg(F.min("value").alias("weights_mib"))
    return _round(P.peak_memory(ev, ["event_type"], "value", weights), "cache_mib")


@query(
    "AGG-12",
    """
    WITH r AS (SELECT l_suppkey AS model, 4096 AS window_size, l_linenumber - 1 AS drop_n, avg(l_extendedprice) AS ppl, sum(l_quantity) AS mem FROM lineitem GROUP BY ALL)
    SELECT a.model, a.drop_n, round(((a.ppl - b.ppl) / b.ppl) / nullif((b.mem - a.mem) / b.mem, 0), 4) AS mpdr
    FROM r a LEFT JOIN r b ON a.model = b.model AND b.drop_n = 0 WHERE a.drop_n > 0
    """,
)
def tradeoff(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as models, line numbers as numbers of dropped layers."""
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model"), F.lit(4096).alias("window"), (F.col("l_linenumber") - 1).alias("drop")).agg(
        F.avg("l_extendedprice").alias("ppl"), F.sum("l_quantity").alias("mem_mib")
    )
    return _round(P.mpdr(runs).select("model", F.col("drop").alias("drop_n"), "mpdr"), "mpdr", digits=4)


@query(
    "AGG-13",
    "SELECT l_linenumber AS layer, round(avg(CAST(l_discount = 0 AS DOUBLE)), 6) AS sparsity, count(*) AS n_params FROM lineitem GROUP BY ROLLUP (l_linenumber)",
)
def zeros(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    params = li.select(F.concat(F.lit("model.layers."), F.col("l_linenumber").cast("string"), F.lit(".w")).alias("name"), F.col("l_discount").alias("value"))
    return _round(P.sparsity(params, layer_of(F.col("name"))), "sparsity")


@query(
    "AGG-14",
    """
    SELECT p_brand, CAST(coalesce(sum(k) FILTER (t), 0) AS BIGINT) AS trainable_params, CAST(sum(k) AS BIGINT) AS all_params, round(coalesce(sum(k) FILTER (t), 0) * 100.0 / sum(k), 4) AS percent
    FROM (SELECT p_brand, p_size % 2 = 0 AS t, CASE WHEN p_retailprice > 1000 THEN p_size * 2 ELSE p_size END AS k FROM part) GROUP BY p_brand
    """,
)
def parameters(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return P.parameter_counts(part, ["p_brand"], F.col("p_size").cast("long"), F.col("p_size") % 2 == 0, F.col("p_retailprice") > 1000)


@query(
    "AGG-15",
    """
    SELECT user_id, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT) * length(event_type)) OVER w AS BIGINT) AS run_sum, CAST(sum(length(event_type)) OVER w AS BIGINT) AS run_count,
           CAST(sum(CAST(round(value * 100) AS BIGINT) * length(event_type)) OVER w AS DOUBLE) / CAST(sum(length(event_type)) OVER w AS DOUBLE) AS run_avg
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def meter(spark: SparkSession, sf: str) -> DataFrame:
    """Values in whole hundredths, so running sums are exact."""
    ev = events(spark, sf).withColumn("n", F.length("event_type")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = P.running_average(ev, "cents", "n", ["user_id"], ["ts", "event_id"], time_chunk("ts", DAY))
    return out.select("user_id", "event_id", "run_sum", "run_count", "run_avg")


@query(
    "AGG-22",
    """
    WITH r AS (SELECT user_id, count(*) AS current_steps, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS elapsed_s FROM events GROUP BY user_id),
    s AS (SELECT *, CAST(floor((1000 - current_steps) * (elapsed_s / current_steps)) AS BIGINT) AS rest FROM r)
    SELECT user_id, current_steps, round(current_steps / 1000 * 100, 2) AS percentage,
      CASE elapsed_s // 86400 WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE (elapsed_s // 86400) || ' days, ' END || printf('%d:%02d:%02d', elapsed_s % 86400 // 3600, elapsed_s % 3600 // 60, elapsed_s % 60) AS elapsed_time,
      CASE rest // 86400 WHEN 0 THEN '' WHEN 1 THEN '1 day, ' ELSE (rest // 86400) || ' days, ' END || printf('%d:%02d:%02d', rest % 86400 // 3600, rest % 3600 // 60, rest % 60) AS remaining_time
    FROM s
    """,
)
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    seconds = F.floor((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1_000_000)
    out = P.progress(events(spark, sf), ["user_id"], F.count(F.lit(1)), F.lit(1000), seconds)
    return out.select("user_id", "current_steps", "percentage", "elapsed_time", "remaining_time")

