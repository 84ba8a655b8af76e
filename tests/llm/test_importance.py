import collections
import math
import random
import zlib

import brute
import pytest

from corpusflow.llm import importance as I


def grams(text, longest):
    w = brute.words(text, brute.ALNUM)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, longest, buckets, seed, percent, least):
    """{row number: (n_features, weight, score, rank)}"""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [[bucket(g) for g in grams(t, longest)] for _, t in rows]
    want = collections.Counter(bucket(g) for t in target for g in grams(t, longest))
    have = collections.Counter(b for o in own for b in o)
    S, T = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (S + buckets) / ((have[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), o in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in o)
        out.append([i, len(o), weight, weight + I.noise(seed, i), None])
    able = [n for n, (_, t) in enumerate(rows) if len(brute.words(t, brute.ALNUM)) >= least]
    order = sorted(able, key=lambda n: (-out[n][3], out[n][0] is not None, out[n][0] or 0))
    for rank, n in enumerate(order[: percent * len(able) // 100], 1):
        out[n][4] = rank
    return sorted(map(tuple, out), key=str)


def test_scans_equal_word_runs():
    texts = ["The  cat, sat.on a MAT-mat!", "", "  ", "x", "é Ñandú 日本 語_x9", "a b\x00c\x7fd", "A" * 50 + " b", "one"]
    for longest in (1, 2, 3, 4):
        scanners = [I.scanner(n) for n in range(1, longest + 1)]
        for t in texts:
            got = I.feature_buckets(I.collapsed(t.encode()), scanners, 2**31).tolist()
            assert got == [zlib.crc32(g.encode()) % 2**31 for g in grams(t, longest)]


@pytest.mark.parametrize("longest,buckets,percent,ranges", [(1, 10_000, 10, 10**6), (2, 50, 40, 7), (3, 7, 100, 10**6), (1, 10, 0, 10**6)])
def test_ranks_equal_brute_force(spark, longest, buckets, percent, ranges, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_RANGE", ranges)
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(80)] + ["é", "Ñ", "日本"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(150)] + [(900 + i, "same words " * 15) for i in range(5)]
    rows += [(900, "same words " * 15)] * 3 + brute.HARD
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(10)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1.5, "r") for i, t in rows], "doc_id long, text string, score double, row string").repartition(4)
    want = plain(rows, target, longest, buckets, 2024, percent, 20)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.importance(docs, goal, longest, buckets, 2024, percent, 20).select("c0", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    drawn = I.resampled(docs, goal, longest=longest, buckets=buckets, percent=percent).collect()
    assert sorted((r["doc_id"] or 0) for r in drawn) == sorted((w[0] or 0) for w in want if w[4]) and all(r["row"] == "r" for r in drawn)


def test_empty_tables(spark):
    docs = spark.createDataFrame(brute.HARD, "doc_id long, text string")
    none = docs.limit(0)
    assert I.importance(none, docs.select("text")).count() == 0
    assert I.importance(docs, none).count() == len(brute.HARD)
