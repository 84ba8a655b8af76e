"""Encoding, truncation, packing, padding, mixing and splitting against plain Python."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusflow.functions.templates import Template, get_template
from corpusflow.operators import examples as E
from corpusflow.operators import mixing as M
from corpusflow.operators.ordering import id_chunk
from corpusflow.schema import IGNORE


@pytest.mark.parametrize("src,tgt,limit,expected", [(30, 10, 20, (15, 5)), (99, 1, 10, (9, 1)), (10, 0, 8, (7, 1)), (0, 0, 8, (7, 1)), (5, 5, 0, (0, 1))])
def test_infer_max_len(spark, src, tgt, limit, expected):
    s, t = E.infer_max_len(F.lit(src), F.lit(tgt), F.lit(limit), 1)
    assert tuple(spark.range(1).select(s, t).first()) == expected


def python_truncate(pairs, cutoff, reserved=1):
    out, total = [], 0
    for s, t in pairs:
        if total >= cutoff:
            break
        left = cutoff - total
        tl = max(int(left * (len(t) / (len(s) + len(t)))) if s or t else 0, reserved)
        s, t = s[: max(left - tl, 0)], t[:tl]
        total += len(s) + len(t)
        out.append((s, t))
    return out


def test_truncate_pairs(spark):
    rng = random.Random(3)
    cases = [[([1] * rng.randrange(0, 12), [2] * rng.randrange(0, 12)) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p array<struct<source:array<int>,target:array<int>>>")
    for cutoff in (5, 17):
        got = {r["i"]: [(p["source"], p["target"]) for p in r["o"]] for r in df.select("i", E.truncate_pairs(F.col("p"), cutoff).alias("o")).collect()}
        assert got == {i: python_truncate(c, cutoff) for i, c in enumerate(cases)}


def test_packing_loses_only_the_rest_of_each_batch(spark):
    df = spark.createDataFrame([(0, [1] * 5), (1, [2] * 4), (2, [3] * 6)], "doc_id long, ids array<int>")
    out = E.pack_pretrain(df, "ids", "doc_id", 4).orderBy("block").collect()
    assert [r["input_ids"] for r in out] == [[1, 1, 1, 1], [1, 2, 2, 2], [2, 3, 3, 3]]
    assert all(r["attention_mask"] == [1] * 4 for r in out)


@pytest.mark.parametrize("batch_rows,block,sparse", [(10, 7, False), (25, 64, True), (1000, 3, True)])
def test_packed_blocks_are_a_prefix_of_the_stream(spark, batch_rows, block, sparse):
    rng = random.Random(block)
    docs = [(i * 37 if sparse else i, [rng.randrange(99) for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>").repartition(5)
    chunk = id_chunk("doc_id", 100) if sparse else None
    got = {}
    for r in E.pack_pretrain(df, "ids", "doc_id", block, chunk, batch_rows).collect():
        got[r["batch"], r["block"]] = r["input_ids"]
    expected = {}
    for b in range(0, len(docs), batch_rows):
        flat = [x for _, ids in docs[b : b + batch_rows] for x in ids]
        for k in range(len(flat) // block):
            expected[b // batch_rows, k] = flat[k * block : (k + 1) * block]
    assert got == expected


def test_mask_and_labels(spark):
    df = spark.createDataFrame([([7, 8, 9], 0), ([7, 8, 9], 2), ([], 1)], "s array<int>, k int")
    assert [r[0] for r in df.select(E.mask_source(F.col("s"), F.col("k"), 5)).collect()] == [[IGNORE] * 3, [5, IGNORE, IGNORE], [5]]
    assert [r[0] for r in df.select(E.lm_labels(F.col("s"), 8)).collect()][0] == [7, IGNORE, 9]
    pads = spark.createDataFrame([([1, 2, 0, 0],), ([1, 2],), ([0, 1],)], "s array<int>")
    assert [r[0] for r in pads.select(E.last_valid_index(F.col("s"), 0)).collect()] == [1, -1, -1]
    blocks = spark.createDataFrame([([IGNORE, 1],), ([IGNORE, IGNORE],)], "labels array<int>")
    assert E.drop_all_ignored(blocks).count() == 1


def test_pad_batch(spark):
    rows = [(0, 0, [1] * 3), (1, 0, [1] * 9), (2, 1, [1] * 8)]
    df = spark.createDataFrame(rows, "i int, b int, input_ids array<int>")
    df = df.withColumn("attention_mask", E.attention_mask(F.col("input_ids"))).withColumn("labels", F.col("input_ids"))
    got = {r["i"]: r for r in E.pad_batch(df, "b", 0).collect()}
    assert [len(got[i]["input_ids"]) for i in range(3)] == [16, 16, 8]
    assert got[0]["attention_mask"] == [1] * 3 + [0] * 13 and got[0]["labels"] == [1] * 3 + [IGNORE] * 13
    left = {r["i"]: r for r in E.pad_batch(df, "b", 0, left=True).collect()}
    assert left[0]["input_ids"] == [0] * 6 + [1] * 3


def test_stages_and_their_checks(spark):
    rows = [(i, [("user", "q w")], [("assistant", f"a {i}"), ("assistant", "b")][: 1 + i % 2], "", "") for i in range(6)]
    msgs = "array<struct<role:string,content:string>>"
    aligned = spark.createDataFrame(rows, f"id long, prompt {msgs}, response {msgs}, system string, tools string")
    enc = E.make_encoding(aligned, "vanilla", 50)
    assert E.build_examples(aligned, "sft", enc, "id").count() == 3
    assert E.build_examples(aligned, "rm", enc, "id").count() == 3
    assert E.build_examples(aligned, "ppo", enc, "id").count() == 6
    assert E.build_examples(aligned, "sft", enc, "id", predict_with_generate=True).count() == 6
    packed = E.build_examples(aligned, "sft", enc, "id", cutoff=4, sft_packing=True).collect()
    assert [len(r["input_ids"]) for r in packed] == [4, 4, 4]
    pt = E.build_examples(aligned, "pt", enc, "id", cutoff=4, batch_rows=3).collect()
    assert len(pt) == 4 and all(r["input_ids"][2] == enc.eos_id for r in pt if r["block"] == 0)
    full = E.encode_sft(aligned, enc, ["id"], train_on_prompt=True).first()
    assert full["labels"] == full["input_ids"]
    efficient = E.Encoding(get_template("falcon"), enc.vocab, eos_id=1)
    with pytest.raises(ValueError, match="train_on_prompt"):
        E.encode_sft(aligned, efficient, ["id"], train_on_prompt=True)
    with pytest.raises(ValueError, match="smaller than the cutoff"):
        E.build_examples(aligned, "sft", enc, "id", cutoff=1)


def python_history(msgs, system, limit):
    rounds = []
    for role, text in msgs:
        if role == "user" or not rounds:
            rounds.append([])
        rounds[-1] += ["<u>" if role == "user" else "<a>", *text.split()]
    sys_tokens, kept = system.split(), []
    for r in rounds[::-1]:
        if kept and len(kept) + len(r) > limit - len(sys_tokens):
            break
        kept = r + kept
        if len(kept) >= limit - len(sys_tokens):
            break
    out = sys_tokens + kept + (["<a>"] if msgs[-1][0] != "assistant" else [])
    return out[-limit:]


def test_trim_history(spark):
    rng = random.Random(1)
    cases = []
    for i in range(40):
        msgs = [(rng.choice(["user", "assistant"]), " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 9)))) for _ in range(rng.randrange(1, 7))]
        cases.append((i, msgs, "s t" if i % 3 == 0 else ""))
    df = spark.createDataFrame(cases, "i int, m array<struct<role:string,content:string>>, s string")
    for limit in (6, 15, 100):
        out = E.trim_history(df, "m", "s", limit, "whitespace", "<u>", "<a>", "x")
        assert {r["i"]: r["x"] for r in out.collect()} == {i: python_history(m, s, limit) for i, m, s in cases}


def test_crop_samples(spark):
    df = spark.createDataFrame([(i, [f"{i}.{k}" for k in range(i)]) for i in range(30)], "id long, t array<string>")
    out = E.crop_samples(df, "id", "t", 5, 20, 7).collect()
    assert len(out) == 5
    for r in out:
        assert r["id"] >= 20 and len(r["sample"]) == 20 and r["sample"] == r["t"][r["start"] : r["start"] + 20]


# Mixing


def ds(spark, *sizes):
    rows = [(d, 100 * d + i) for d, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "d int, id long").repartition(3)


def by_slot(df):
    return [r["id"] for r in df.orderBy("slot").collect()]


def test_interleave(spark):
    df, chunk = ds(spark, 3, 5), id_chunk("id", 2)
    assert by_slot(M.interleave_under(df, "d", "id", chunk)) == [0, 100, 1, 101, 2, 102]
    assert by_slot(M.interleave_over(df, "d", "id", chunk)) == [0, 100, 1, 101, 2, 102, 0, 103, 1, 104]


def test_interleave_over_with_many_repetitions(spark, monkeypatch):
    monkeypatch.setattr(M, "WRAP_BLOCK", 4)
    out = M.interleave_over(ds(spark, 2, 50), "d", "id", id_chunk("id", 7)).orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(100))
    assert [r["id"] for r in out if r["d"] == 0] == [0, 1] * 25 and [r["id"] for r in out if r["d"] == 1] == list(range(100, 150))


@pytest.mark.parametrize("over", [False, True])
def test_interleave_probs(spark, over):
    sizes = (30, 10)
    out = M.interleave_probs(ds(spark, *sizes), "d", "id", id_chunk("id", 8), [0.5, 0.5], 3, over).orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(len(out)))
    seen = {0: 0, 1: 0}
    for r in out:
        assert r["id"] == 100 * r["d"] + seen[r["d"]] % sizes[r["d"]]
        seen[r["d"]] += 1
    last = out[-1]["d"]
    if over:
        assert all(seen[d] >= sizes[d] for d in seen) and seen[last] == sizes[last]
    else:
        assert seen[last] == sizes[last] and all(seen[d] < sizes[d] for d in seen if d != last)


def test_one_row_against_many_slots(spark, monkeypatch):
    """Its slots are met by as many copies of it as they are blocks."""
    monkeypatch.setattr(M, "WRAP_BLOCK", 40)
    out = M.interleave_probs(ds(spark, 1, 900), "d", "id", id_chunk("id", 100), [0.6, 0.4], 3, True).orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(len(out)))
    assert {r["id"] for r in out if r["d"] == 0} == {0} and [r["id"] for r in out if r["d"] == 1] == list(range(100, 1000))
    assert sum(r["d"] == 0 for r in out) > 1000


def test_splits_are_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for size, n in ((0.1, 100), (37, 37), (0.0015, 2), (0, 0)):
        rows = M.train_test_split(df, "k", size, 5).collect()
        assert len(rows) == 1000 and sum(r["split"] == "test" for r in rows) == n
    again = {r["k"] for r in M.train_test_split(df.repartition(7), "k", 37, 5).collect() if r["split"] == "test"}
    assert again == {r["k"] for r in M.train_test_split(df, "k", 37, 5).collect() if r["split"] == "test"}


def test_shuffles_are_permutations(spark):
    df = spark.range(500)
    slots = sorted((r["slot"], r["id"]) for r in M.buffered_shuffle(df, "id", "id", 1, 64).collect())
    assert [s for s, _ in slots] == list(range(500)) and all(s // 64 == i // 64 for s, i in slots)
    assert [s for s, _ in slots] != [i for _, i in slots]
    assert sorted(r["slot"] for r in M.full_shuffle(df, "id", 1).collect()) == list(range(500))


def test_calibration(spark):
    df = spark.range(50)
    got = M.calibration_sample(df, "id", 20, 4, id_chunk("id", 6)).collect()
    assert sorted(r["id"] for r in got) == list(range(20)) and {r["worker"] for r in got} == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="evenly"):
        M.calibration_sample(df, "id", 21, 4, id_chunk("id"))
    with pytest.raises(PySparkException, match="more calibration samples"):
        M.calibration_sample(df, "id", 52, 4, id_chunk("id")).collect()


def test_limit_per_dataset(spark):
    out = M.limit_per_dataset(ds(spark, 3, 50, 0, 7), "d", "id", 5, id_chunk("id", 4))
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2] + list(range(100, 105)) + list(range(300, 305))


def message_rows(spark, chats):
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t, f"sys {c % 3}" if c % 2 else "") for c, texts in chats.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv long, idx int, role string, content string, system string").repartition(7)


def whole_rows(messages):
    """The small path: every conversation in one record."""
    return E._one_row(messages, "conv", False)


@pytest.mark.parametrize("cutoff,reserved,template", [(12, 1, "chatml"), (40, 5, "chatml"), (9, 3, "falcon"), (3, 3, "plain")])
def test_turns_encode_as_whole_conversations(spark, cutoff, reserved, template):
    if template == "plain":  # renders nothing around the texts, so messages may have no tokens at all
        template = Template("bare", assistant=("{{content}}",))
    rng = random.Random(cutoff)
    words = lambda: " ".join(rng.choices("abcdefgh", k=rng.choice([0, 0, 1, 2, 5, 30])))
    chats = {c: [words() for _ in range(2 * rng.randrange(1, 9))] for c in range(80)}
    messages = message_rows(spark, chats)
    enc = E.make_encoding(whole_rows(messages), template, 500, has_tools=False)
    for stage, encode in (("sft", E.encode_sft), ("ppo", E.encode_prompt_only)):
        want = encode(whole_rows(messages), enc, ["conv"], cutoff, reserved)
        got = E.encode_turns(messages, "conv", enc, cutoff, reserved, stage)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_conversation_of_many_turns(spark):
    many = spark.range(200_000).select(
        F.lit(1).cast("long").alias("conv"), F.col("id").cast("int").alias("idx"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id")).alias("content"), F.lit("").alias("system"),
    )
    few = many.where("idx < 100")
    enc = E.make_encoding(whole_rows(few), "chatml", 500, has_tools=False)
    kept = E.fitting_turns(many, "conv", enc, 64).first()
    assert len(kept["prompt"]) + 1 < 40
    assert E.encode_turns(many, "conv", enc, 64).first() == E.encode_sft(whole_rows(few), enc, ["conv"], 64).first()
    assert E.newest_turns(many, "conv", "system", 50, "whitespace").count() < 40
    got = E.trim_turns(many, "conv", "system", 50, "whitespace", "<user>", "<assistant>", "out").first()["out"]
    assert got[-3:] == ["<assistant>", "turn", "199999"] and len(got) <= 50 and got[0] == "<user>"


@pytest.mark.parametrize("limit", [1, 6, 25, 1000])
def test_turns_trim_as_whole_conversations(spark, limit):
    rng = random.Random(limit)
    roles = lambda n: [rng.choice(["user", "user", "assistant", "tool"]) for _ in range(n)]
    rows = [
        (c, i, r, " ".join(rng.choices("abc", k=rng.choice([0, 1, 4, 9]))), ["", "sys of it"][c % 2]) for c in range(60) for i, r in enumerate(roles(rng.randrange(1, 14)))
    ]
    messages = spark.createDataFrame(rows, "conv long, idx int, role string, content string, system string").repartition(5)
    items = F.array_sort(F.collect_list(F.struct("idx", "role", "content")))
    whole = messages.groupBy("conv").agg(F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("m"), F.first("system").alias("s"))
    args = (limit, "whitespace", "<u>", "<a>", "out")
    want = E.trim_history(whole, "m", "s", *args).select("conv", "out")
    got = E.trim_turns(messages, "conv", "system", *args)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
