"""Similarity, selection, retention, losses, vectors and reports on hand-made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import reports as P
from corpusflow.operators import retention as K
from corpusflow.operators import scoring as C
from corpusflow.operators import selection as S
from corpusflow.operators import similarity as Y
from corpusflow.operators import vectors as V
from corpusflow.operators.ordering import id_chunk

STATES = "run_id string, target string, layer int, sample_id long, token_pos long, h_in array<float>, h_out array<float>"


def states(spark, runs=2, layers=4, samples=5, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    rows, cube = [], {}
    for r in range(runs):
        for s in range(samples):
            for t in range(1 + 3 * s):
                h = rng.normal(size=(layers + 1, dim)).astype(np.float32)
                cube[r, s, t] = h
                rows += [(f"r{r}", "attn", l, s, t, h[l].tolist(), h[l + 1].tolist()) for l in range(layers)]
    return spark.createDataFrame(rows, STATES).repartition(5), cube


def cos(a, b):
    a, b = a.astype(float), b.astype(float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_similarities(spark):
    df, cube = states(spark)
    block = {(r["run_id"], r["layer"]): r["score"] for r in Y.block_similarity(df).collect()}
    resid = {(r["run_id"], r["layer"]): r["score"] for r in Y.layer_similarity(df).collect()}
    gaps = {(r["run_id"], r["layer"], r["gap"]): r["score"] for r in Y.gap_similarity(df).collect()}
    assert len(gaps) == 2 * 10
    for r in range(2):
        for l in range(4):
            per = [[(cos(h[l], h[l + 1]), cos(h[l], h[l].astype(float) + h[l + 1])) for (a, s, t), h in cube.items() if (a, s) == (r, s0)] for s0 in range(5)]
            assert block[f"r{r}", l] == pytest.approx(np.mean([np.mean([c[0] for c in p]) for p in per]))
            assert resid[f"r{r}", l] == pytest.approx(np.mean([np.mean([c[1] for c in p]) for p in per]))
            for g in range(1, 5 - l):
                pooled = [cos(h[l], h[l + g]) for (a, _, _), h in cube.items() if a == r]
                assert gaps[f"r{r}", l, g] == pytest.approx(np.mean(pooled))


def test_two_means_differ(spark):
    one, zero = [1.0, 0.0], [0.0, 1.0]
    rows = [("r", "attn", 0, 0, t, one, one) for t in range(4)] + [("r", "attn", 0, 1, 0, one, zero)]
    df = spark.createDataFrame(rows, STATES)
    assert Y.block_similarity(df).first()["score"] == pytest.approx(0.5)
    assert Y.gap_similarity(df).first()["score"] == pytest.approx(0.8)


def scores(spark, *runs):
    rows = [(f"r{i}", "attn", l, s) for i, run in enumerate(runs) for l, s in enumerate(run)]
    return spark.createDataFrame(rows, "run_id string, target string, layer int, score double")


def test_selection(spark):
    df = scores(spark, [0.1, 0.9, None, 0.9, 0.5], [float("-inf"), 0.2, 0.3, -0.5, None])
    got = {(r["run_id"], r["layer"]) for r in S.select_drop(df, 2).collect()}
    assert got == {("r0", 1), ("r0", 3), ("r1", 2), ("r1", 1)}
    near = {r["run_id"]: r["layer"] for r in S.argmax_with_tolerance(scores(spark, [0.1, 0.895, 0.9], [0.5, 0.2, 0.1]), 0.01).collect()}
    assert near == {"r0": 1, "r1": 0}


def test_greedy_top_k(spark):
    df = scores(spark, [0.3, 0.5, 0.499, 0.1], [-0.5, -0.2, -0.3, -0.4])
    out = S.greedy_top_k(df, 3, 0.01).orderBy("run_id", "round").collect()
    # Picked scores become 0, so among negative ones the same layer is picked again.
    assert [r["layer"] for r in out] == [1, 2, 0, 1, 1, 1]


def test_select_block_gap_columns(spark):
    rows = [("r", l, g, (10 * g + l) / 100) for l in range(4) for g in range(1, 5 - l)]
    m = spark.createDataFrame(rows, "run_id string, layer int, gap int, score double")
    assert sorted(r["layer"] for r in S.select_block(m, 2).collect()) == [1, 2]
    assert sorted(r["layer"] for r in S.select_block(m, 2, "exact").collect()) == [2, 3]


def test_iterative_drop_rescores(spark):
    base = scores(spark, [0.9, 0.8, 0.7, 0.1])

    def score(gone):
        if gone is None:
            return base
        # Once layer 0 is gone, layer 3 becomes the best.
        return base.withColumn("score", F.when(F.col("layer") == 3, 2.0).otherwise(F.col("score")))

    out = S.iterative_drop(score, 1, 3).orderBy("epoch").collect()
    assert [r["layer"] for r in out] == [0, 3, 1]


@pytest.mark.parametrize(
    "raw,indices,expected",
    [
        ([True, False, True, False], False, "TFTF"),
        ([0, 2], True, "TFTF"),
        ([1, 3], True, "FTFT"),
        ([], True, "FFFF"),
        (None, False, "FFFF"),
        (None, True, "FFFF"),
        ([True] * 4, False, "TTTT"),
        ([True, True], False, "TTFF"),
        ([False, False], False, "FFFF"),
        ([True] * 6, False, "TTTT"),
    ],
)
def test_normalise_drop_list(spark, raw, indices, expected):
    df = spark.createDataFrame([(raw,)], "x array<int>" if indices else "x array<boolean>")
    got = df.select(S.normalise_drop_list(F.col("x"), 4, indices)).first()[0]
    assert "".join("T" if v else "F" for v in got) == expected


@pytest.mark.parametrize("dropped,n", [([1], 3), ([0], 3), ([3], 3), ([1, 2], 2), ([0, 1, 2, 3], 0), ([], 4)])
def test_active_slots(spark, dropped, n):
    plan = spark.createDataFrame([("r", l, l in dropped) for l in range(4)], "run_id string, layer int, drop_attn boolean")
    got = S.active_slots(plan).orderBy("layer").collect()
    assert [r["slot"] for r in got] == list(range(n)) and all(r["n_slots"] == n for r in got)


def test_joint_ids_and_plan(spark):
    df = spark.createDataFrame([("r", 5), ("r", 40)], "run_id string, layer int")
    assert {(r["module"], r["layer"]) for r in S.split_joint(df, 32).collect()} == {("attn", 5), ("mlp", 8)}
    plan = S.plan_json(spark.createDataFrame([("r", l) for l in (11, 0, 2)], "run_id string, layer int")).first()
    assert plan["reserved_layers"] == "[0,2,11]" and plan["layer_mapping"] == '{"0":0,"2":1,"11":2}'


# Streams


@pytest.mark.parametrize("length,start,recent,coming,expected", [
    (20, 4, 8, 0, [0, 1, 2, 3, *range(12, 20)]), (12, 4, 8, 0, list(range(12))), (20, 4, 8, 1, [0, 1, 2, 3, *range(13, 20)]),
    (11, 4, 8, 1, list(range(11))), (5, 0, 2, 0, [3, 4]),
])
def test_retention(spark, length, start, recent, coming, expected):
    rows = [(s, i, i * 10 + s) for s in range(3) for i in range(length)]
    df = spark.createDataFrame(rows, "s int, id long, v int").repartition(4)
    for width in (3, 1000):
        out = K.retain_for_space(df, ["s"], ["id"], start, recent, coming, id_chunk("id", width)).collect()
        for s in range(3):
            assert sorted(r["pos"] for r in out if r["s"] == s) == expected
    with pytest.raises(ValueError):
        K.retain_for_space(df, ["s"], ["id"], 4, 8, 9, id_chunk("id"))


def visible(length, n_init, n_local):
    return {i: {j for j in range(i + 1) if j < n_init or j >= i - n_local + 1} for i in range(length)}


@pytest.mark.parametrize("length,n_init,n_local", [(16, 2, 4), (32, 4, 8), (128, 8, 16), (4, 2, 32), (16, 2, 32), (8, 2, 8), (64, 4, 8), (9, 0, 3)])
def test_visibility(spark, length, n_init, n_local):
    df = spark.range(length).withColumnRenamed("id", "pos")
    got = {i: set() for i in range(length)}
    pairs = K.visible_pairs(df, "pos", n_init, n_local).collect()
    for r in pairs:
        got[r["pos"]].add(r["key_pos"])
    assert got == visible(length, n_init, n_local) and len(pairs) == sum(map(len, got.values()))
    counts = {r["pos"]: r["n"] for r in df.select("pos", K.visible_count(F.col("pos"), n_init, n_local).alias("n")).collect()}
    assert counts == {i: len(k) for i, k in got.items()}


def test_cache_positions(spark):
    df = spark.range(10).select(K.cache_position(F.col("id"), 2, 4).alias("p"))
    assert [r["p"] for r in df.collect()] == [0, 1, 2, 3, 4, 5, 2, 3, 4, 5]
    kept = K.retain_sink_recent(spark.range(20).withColumn("s", F.lit(0)), ["s"], ["id"], 4, 8, id_chunk("id", 5))
    live = K.live_positions(kept, ["s"], 4, 8).orderBy("pos").collect()
    assert [r["cache_pos"] for r in live] == list(range(12)) and {r["next_pos"] for r in live} == {12}


def python_nll(tokens, v, start=None, recent=None):
    out = []
    for i in range(1, len(tokens)):
        seen = [j for j in range(i) if recent is None or j < start or j >= i - 1 - recent]
        p = (sum(tokens[j] == tokens[i] for j in seen) + 1) / (len(seen) + v)
        out.append(-math.log(p))
    return out


@pytest.mark.parametrize("rows", [5, 17, 1000])
def test_window_scored_nll(spark, rows):
    rng = random.Random(2)
    streams = {k: [rng.choice("aaabc") for _ in range(n)] for k, n in ((0, 80), (1, 3), (2, 1))}
    df = spark.createDataFrame([(k, i, t) for k, ts in streams.items() for i, t in enumerate(ts)], "k int, pos long, token string")
    for start, recent in ((None, None), (2, 4), (0, 1), (6, 2), (100, 3)):
        out = C.window_scored_nll(df, "k", "pos", "token", 3, start, recent, rows=rows).collect()
        for k, ts in streams.items():
            got = [r["nll"] for r in sorted(out, key=lambda r: r["pos"]) if r["k"] == k]
            assert got == pytest.approx(python_nll(ts, 3, start, recent)), (k, start, recent)


@pytest.mark.parametrize("rows", [3, 100])
def test_next_token_label(spark, rows):
    df = spark.createDataFrame([(k, i, f"{k}.{i}") for k in range(2) for i in range(10)], "k int, pos long, token string")
    out = C.next_token_label(df, "k", "pos", "token", rows).collect()
    assert sorted((r["token"], r["label"]) for r in out) == sorted((f"{k}.{i}", f"{k}.{i + 1}") for k in range(2) for i in range(9))


def test_score_streams_gets_context(spark):
    df = spark.createDataFrame([(0, i, str(i)) for i in range(25)], "k int, pos long, token string")
    sizes = C.score_streams(df, "k", "pos", "token", lambda f: f["pos"] - f["pos"].min(), segment=10, overlap=3)
    got = {r["pos"]: r["nll"] for r in sizes.collect()}
    assert got == {i: (i if i < 10 else i - (i // 10 * 10 - 3)) for i in range(25)}


def test_token_nll_and_losses(spark):
    rows = [(0, [1.0, 2.0, 3.0], 2), (1, [1000.0, 0.0], 1), (2, [0.5], 0), (3, [0.1, 0.2], 7)]
    df = spark.createDataFrame(rows, "i int, x array<float>, y int")
    got = [r[0] for r in df.orderBy("i").select(V.token_nll("x", "y")).collect()]
    assert got[0] == pytest.approx(math.log(sum(math.exp(v) for v in (1, 2, 3))) - 3)
    assert got[1] == pytest.approx(1000) and got[2] == pytest.approx(0) and got[3] is None


# Vectors


def test_topk_routing_and_balance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(x)], "i int, s int, x array<double>").repartition(3)
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    for r in V.topk_routing(df, "x", 2).collect():
        best = np.argsort(-p[r["i"]])[:2]
        assert list(r["route"]["experts"]) == best.tolist()
        assert r["route"]["weights"] == pytest.approx((p[r["i"]][best] / p[r["i"]][best].sum()).tolist())
    picks = np.zeros((40, 6))
    for i in range(40):
        picks[i, np.argsort(-p[i])[:2]] = 1
    expected = 0.1 * (p.mean(0) * 6 * picks.sum(0) / 80).sum()
    assert V.load_balance(df, "x", 2, 0.1).first()[0] == pytest.approx(expected)
    per = [0.1 * (p[s::4].mean(0) * picks[s::4].sum(0) / (10 * 2 / 6)).sum() for s in range(4)]
    assert V.load_balance(df, "x", 2, 0.1, "s").first()[0] == pytest.approx(np.mean(per))


def test_group_mean_pool(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0],)], "x array<double>")
    assert V.group_mean_pool(df, "x", 4, 2).first()["pooled"] == [2.0, 3.0, 6.0, 7.0]
    assert V.group_mean_pool(df, "x", 2, 2).first()["pooled"] == [float(i) for i in range(1, 9)]
    with pytest.raises(ValueError):
        V.group_mean_pool(df, "x", 4, 3)


def test_upsert_and_difference(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "n string, v double")
    b = spark.createDataFrame([("y", None), ("z", 3.0)], "n string, v double")
    assert {r["n"]: r["v"] for r in V.upsert_params(a, b, "n", "v").collect()} == {"x": 1.0, "y": None}
    long = spark.createDataFrame([("w", i, float(i)) for i in range(4)], "n string, e int, v double")
    patch = spark.createDataFrame([("w", 2, 9.0)], "n string, e int, v double")
    assert [r["v"] for r in V.upsert_params(long, patch, ["n", "e"], "v").orderBy("e").collect()] == [0.0, 1.0, 9.0, 3.0]
    d = V.max_abs_diff(a, a.withColumn("v", F.col("v") + 1e-7), ["n"], "v", 1e-5).first()
    assert d["equal"] and d["max_diff"] == pytest.approx(1e-7)
    assert not V.max_abs_diff(a, b, ["n"], "v", 1e-5).first()["equal"]


# Reports


def test_published_tradeoffs(spark):
    rows = [("llama", 4096, 0, 5.36, 512.0), ("llama", 4096, 8, 6.57, 384.0), ("llama", 8192, 8, 6.76, 768.0), ("mistral", 4096, 0, 4.68, 512.0), ("mistral", 4096, 8, 6.10, 384.0)]
    runs = spark.createDataFrame(rows, "model string, window int, drop int, ppl double, mem_mib double")
    got = {(r["model"], r["window"]): r["mpdr"] for r in P.mpdr(runs).collect()}
    assert got["llama", 4096] == pytest.approx(0.90, abs=0.005) and got["mistral", 4096] == pytest.approx(1.21, abs=0.005)
    assert got["llama", 8192] is None


@pytest.mark.parametrize("kept,window,mib", [(32, 4096, 512), (24, 4096, 384), (24, 8192, 768), (20, 8192, 640)])
def test_kv_footprint(spark, kept, window, mib):
    plan = spark.createDataFrame([("r", l, l >= kept) for l in range(32)], "run_id string, layer int, drop_attn boolean")
    assert P.kv_footprint(plan, ["run_id"], F.lit(8), F.lit(128), F.lit(window)).first()["mib"] == mib


def test_speed_and_oom(spark):
    rows = [(1, "prefill", 0.5, False), (1, "decode", 0.1, False), (1, "decode", 0.2, False), (1, "decode", 0.4, False), (2, "prefill", 1.0, True)]
    df = spark.createDataFrame(rows, "c int, phase string, s double, oom boolean")
    got = {r["c"]: (r["prefill_tokens_s"], r["decode_tokens_s"]) for r in P.speed_summary(df, ["c"], "s", "phase", F.lit(32), 2, F.col("oom")).collect()}
    assert got == {1: ("128.0", "10.0"), 2: ("OOM", "OOM")}
    sweep = spark.createDataFrame([("m", i, "OOM" if i in (2, 4) else "1") for i in range(5)] + [("n", 0, "1")], "m string, i int, prefill_tokens_s string")
    assert sorted((r["m"], r["i"]) for r in P.stop_after_oom(sweep, ["m"], "i").collect()) == [("m", 0), ("m", 1), ("m", 2), ("n", 0)]


def test_grid_zips_tasks(spark):
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    out = P.experiment_grid(models, ["mlp", "attn"], [4, 8], ["t1", "t2", "t3"], [0, 5, 25])
    assert out.count() == 2 * 2 * 2 * 3 and {(r["task"], r["n_shot"]) for r in out.collect()} == {("t1", 0), ("t2", 5), ("t3", 25)}
    with pytest.raises(ValueError):
        P.experiment_grid(models, ["mlp"], [4], ["t1"], [])


def test_compare_runs_keeps_one_sided_metrics(spark):
    m = spark.createDataFrame([("a", "ppl", 1.0), ("b", "ppl", 2.0), ("a", "mem", 3.0), ("c", "ppl", 9.0)], "run_id string, metric string, value double")
    assert {r["metric"]: (r["value_a"], r["value_b"]) for r in P.compare_runs(m, "a", "b").collect()} == {"ppl": (1.0, 2.0), "mem": (3.0, None)}


def test_clock(spark):
    import datetime

    for s in (0, 59, 3661, 86_399, 86_400, 200_000):
        assert spark.range(1).select(P.clock(F.lit(s))).first()[0] == str(datetime.timedelta(seconds=s))


def test_parameter_counts_and_sparsity(spark):
    p = spark.createDataFrame([("m", 10, True, False), ("m", 10, False, True)], "m string, n long, t boolean, q boolean")
    r = P.parameter_counts(p, ["m"], F.col("n"), F.col("t"), F.col("q")).first()
    assert (r["trainable_params"], r["all_params"], r["percent"]) == (10, 30, 33.3333)
    from corpusflow.functions.strings import layer_of

    rows = [("model.layers.3.w", 0.0), ("model.layers.3.w", 1.0), ("model.layers.5.w", 0.0), ("lm_head", 0.0)]
    df = spark.createDataFrame(rows, "name string, value double")
    got = {r["layer"]: r["sparsity"] for r in P.sparsity(df, layer_of(F.col("name"))).collect()}
    assert got == {3: 0.5, 5: 1.0, None: pytest.approx(2 / 3)}


def test_arrays_are_scored_like_streams(spark):
    """Arrays count inside their row; those that share a key, or have none, are one stream as in a token table."""
    rng = random.Random(3)
    arrays = [(k, [rng.choice("aaabcd") for _ in range(n)]) for k, n in ((0, 60), (1, 3), (2, 1), (3, 0), (4, 25), (4, 25), (None, 9), (None, 4))]
    df = spark.createDataFrame([*arrays, (5, None)], "k int, t array<string>").repartition(3)
    tokens = C.token_stream(df, "k", "t")
    plan = lambda out: out._jdf.queryExecution().toString()
    for start, recent in ((None, None), (2, 4), (0, 1), (6, 2), (100, 3)):
        alone = C.window_scored_arrays(df.where("k < 4"), "k", "t", 4, start, recent)
        assert "Window" not in plan(alone)
        for k, ts in arrays[:4]:
            got = [r["nll"] for r in sorted(alone.collect(), key=lambda r: r["pos"]) if r["k"] == k]
            assert got == pytest.approx(python_nll(ts, 4, start, recent)), (k, start, recent)
        rows = lambda out: sorted((str(r["k"]), r["pos"], r["token"], round(r["nll"], 9)) for r in out.collect())
        few = df.where("k < 5")
        got = rows(C.window_scored_arrays(few, "k", "t", 4, start, recent))
        assert [g[:3] for g in got] == [g[:3] for g in rows(C.window_scored_nll(tokens.where("k < 5"), "k", "pos", "token", 4, start, recent))]
    assert len(C.window_scored_arrays(df, "k", "t", 4, 2, 4).collect()) == tokens.where("pos > 0").count()
    for scorer in (lambda f: f["pos"] - f["pos"].min(), lambda f: f["token"].str.len() + f["pos"]):
        got = C.score_arrays(df.where("k < 4"), "k", "t", scorer, segment=10, overlap=3)
        assert "Exchange" not in plan(C.score_arrays(spark.createDataFrame(arrays[:4], df.schema), "k", "t", scorer, segment=10, overlap=3))
        want = C.score_streams(tokens.where("k < 4"), "k", "pos", "token", scorer, segment=10, overlap=3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema
    assert C.score_arrays(df, "k", "t", scorer, segment=10, overlap=3).count() == tokens.count()


def test_next_tokens_of_arrays(spark):
    df = spark.createDataFrame([(0, list("abab")), (1, ["a"]), (2, []), (3, None), (None, list("ba"))], "k int, t array<string>")
    got = sorted((str(r["k"]), r["pos"], r["token"], r["label"]) for r in C.next_token_pairs(df, "k", "t").collect())
    assert got == [("0", 0, "a", "b"), ("0", 1, "b", "a"), ("0", 2, "a", "b"), ("None", 0, "b", "a")]
