import itertools
import random

import brute
import numpy as np
import pytest

from corpusflow.llm import line_dedup as L


def test_distance_of_all_short_strings():
    every = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(every, every):
        d = brute.edit_distance(a, b)
        assert [L.distance_within(a, b, t) for t in range(4)] == [d <= t for t in range(4)]


def test_bags_never_rule_out_a_link():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é\U0001f600") for _ in range(rng.choice([20, 60, 200, 700]))) for _ in range(12)]
    texts = [changed(rng, x, n) for x in base for n in (0, 1, 2, 3, 6, 9, 12)] + [""]
    bags, n = L.Bags(texts, 2), np.arange(len(texts))
    ruled_out = 0
    for x in range(len(texts)):
        one = bags.possible(x, n)
        assert one.tolist() == bags.possible(np.full(len(n), x), n).tolist()
        assert all(one[y] for y in range(len(texts)) if L.linked_lines(texts[x], texts[y], 2))
        ruled_out += int((~one).sum())
    assert ruled_out > len(texts) ** 2 // 2


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        i, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.3:
            out.insert(i, "x")
        elif kind < 0.6 and len(out) > 2:
            del out[i]
        else:
            out[i] = "y"
    return "".join(out)


@pytest.mark.parametrize("edits,block,sample", [(1, 4096, 64), (2, 4096, 1), (3, 3, 1)])
def test_lines_equal_brute_force(spark, edits, block, sample, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "SAMPLE", sample)  # 1: every key of three lines is hot
    monkeypatch.setattr(L, "LEAST", 3)
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(8, 40))) for _ in range(40)]
    docs = [(i, "\n".join(changed(rng, rng.choice(base), rng.randrange(0, 4)) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "\n"), (203, "short\nshort")]
    lines = sorted({x for _, t in docs for x in (t or "").split("\n") if len(x) >= 10})
    union = brute.Union(lines)
    for a, b in itertools.combinations(lines, 2):
        if abs(len(a) - len(b)) <= edits and brute.edit_distance(a, b) <= edits:
            union.join(a, b)
    seen, want = set(), {}
    for i, t in docs:
        kept = []
        for x in (t or "").split("\n"):
            if len(x) >= 10:
                if union.find(x) in seen:
                    continue
                seen.add(union.find(x))
            kept.append(x)
        want[i] = "\n".join(kept) if t is not None else None
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["c0"]: r for r in L.deduplicated(df, edits, 10).collect()}
    assert {i: r["clean"] for i, r in got.items()} == want
    assert (got[200]["n_lines"], got[201]["n_lines"], got[202]["n_lines"]) == (0, 1, 2)


def test_hard_rows(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in brute.HARD], "doc_id long, text string, gone int")
    got = L.deduplicated(df).collect()
    assert len(got) == len(brute.HARD)
    assert sum(r["n_removed"] for r in got if r["c0"] == 7) == 0
    assert L.deduplicated(df.limit(0)).count() == 0


def test_texts_of_one_id_lose_only_their_own_lines(spark):
    repeated, other = "a line that stands in several texts", "another one that is repeated elsewhere"
    own = [f"{w} stands nowhere else at all" for w in ("aaaaaaaaaa", "bbbbbbbbbb", "cccccccccc", "dddddddddd", "eeeeeeeeee")]
    rows = [
        (None, f"{own[0]}\n{repeated}"), (None, f"{repeated}\n{own[1]}"), (None, f"{own[2]}\n{own[3]}"),
        (3, other), (4, other), (4, own[4]), (4, own[4]),
    ]
    got = L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, own[0], 1), (None, f"{repeated}\n{own[1]}", 0), (None, rows[2][1], 0), (3, other, 0), (4, "", 1), (4, own[4], 0), (4, own[4], 0)]
    assert sorted(((r["c0"], r["clean"], r["n_removed"]) for r in got), key=repr) == sorted(want, key=repr)


def test_one_place_of_several_texts_of_one_id(spark):
    rows = [(5, "the same first line of two texts\nfoo"), (5, "the same first line of two texts\nbar")]
    got = L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 1] and {r["clean"].split("\n")[-1] for r in got} == {"foo", "bar"}


def varied(rng, text, n):
    """``text`` after at most n edits anywhere, all kinds, at times all at one place."""
    for at in [rng.randrange(len(text))] * n if rng.random() < 0.3 else [rng.randrange(len(text)) for _ in range(n)]:
        text = text[:at] + rng.choice(["x", "", "y" + text[at : at + 1]]) + text[at + 1 :]
    return text


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_classes_hold_every_length_once(edits):
    every = L.classes(5000, edits)
    assert every[0][0] == 0 and every[-1][1] >= 5000
    assert all(high + 1 == low for (_, high, _), (low, _, _) in itertools.pairwise(every))
    assert all(L.edits_of(n, edits) == t for low, high, t in every for n in (low, high))


def test_hot_keys_are_found_and_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    common = "the same beginning of very many lines "
    rows = [(i, common + "".join(rng.choice("abcdefgh") for _ in range(38))) for i in range(400)]
    rows += [(1000 + i, changed(rng, text, 1)) for i, text in rows[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert L.hot_keys(docs, 2, 20) == []
    monkeypatch.setattr(L, "SAMPLE", 1)
    assert L.hot_keys(docs, 2, 20)
    got = {r["c0"]: r["n_removed"] for r in L.deduplicated(docs).collect()}
    assert got == {i: int(i >= 1000) for i, _ in rows}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edits_grow_with_length(edits):
    allowed = [L.edits_of(n, edits) for n in range(3000)]
    assert allowed == sorted(allowed) and allowed[48 * (edits + 1) - 1] == edits
    for t in range(edits + 1, max(allowed) + 1):
        assert allowed.index(t) == L.shortest(t)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_linked_lines_share_a_key(edits):
    rng = random.Random(edits)
    ends = [L.shortest(t) for t in range(edits + 1, 14)]
    lengths = [rng.choice(ends) + rng.randrange(-9, 10) for _ in range(600)] + [rng.randrange(30, 1500) for _ in range(600)]
    far = 0
    for n in lengths:
        x = "".join(rng.choice("abcdefgh ") for _ in range(n))
        y = varied(rng, x, rng.randrange(1, L.edits_of(n, edits) + 1))
        if x == y or not L.linked_lines(x, y, edits):
            continue
        lines = L.HashedLines([f"{x}\n{y}"])
        own = [{}, {}]
        for key, row in L.keys_of(lines, np.arange(2), edits):
            for k, r in zip(key.tolist(), row.tolist(), strict=True):
                side = own[int(r >> 1 == lines.ids(np.arange(1, 2))[0])]
                side[k] = side.get(k, 0) | r & 1
        assert any(own[0][k] | own[1][k] for k in own[0].keys() & own[1].keys()), (n, x, y)
        far += brute.edit_distance(x, y) > edits if n < 300 else 0
    assert far > 20


def test_a_word_in_a_long_line(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    line, other, more = " ".join(words), " ".join([*words[:20], "changes", *words[21:]]), " ".join([*words[:20], *words[32:]])
    rows = [(1, line), (2, other), (3, more), (4, " ".join(reversed(words)))]
    got = {r["c0"]: r["n_removed"] for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_small_lists_are_compared_together(spark, monkeypatch):
    """Many short lists of lines that are apart: one count of characters for all of them, not one for each."""
    from corpusflow.llm import graph as G

    seen = []
    monkeypatch.setattr(L, "forest", lambda rows, *a, **b: seen.append((rows, a, b)) or G.forest(rows, *a, **b))
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdefghijkl ") for _ in range(16)) for _ in range(60)]
    texts = [s + "".join(rng.choice("mnopqr") for _ in range(8)) for s in stems for _ in range(5)]
    texts += [changed(rng, t, 1) for t in texts[::3]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["c0"]: r["n_removed"] for r in L.deduplicated(df).collect()}
    union = brute.Union(texts)
    for a, b in itertools.combinations(texts, 2):
        if abs(len(a) - len(b)) <= 2 and brute.edit_distance(a, b) <= 2:
            union.join(a, b)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(union.find(t), i)
    assert got == {i: int(first[union.find(t)] != i) for i, t in enumerate(texts)}
    (rows, (matcher, *kin), more), *_ = seen
    one, together = G.forest(rows, matcher, *kin), G.forest(rows, matcher, *kin, **more)
    label = lambda links: {r["id"]: r["label"] for r in G.components(links).collect()}
    assert "few" in more and label(one) == label(together) and together.count() <= one.count()


def test_keys_travel_in_arrays(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcd") for _ in range(rng.randrange(20, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, f"{t}\n{changed(rng, t, 2)}") for i, t in enumerate(lines)], "doc_id long, text string")
    rows = {}
    hashed = L.HashedLines([t for r in df.collect() for t in r["text"].split("\n")])
    for key, row in L.keys_of(hashed, np.flatnonzero(hashed.lengths >= 20), 2):
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            at = rows.setdefault(k, {})
            at[r >> 1] = at.get(r >> 1, False) or bool(r & 1)
    want = {(k, i, x) for k, at in rows.items() if len(at) > 1 and any(at.values()) for i, x in at.items()}
    found = L.shared_keys(df, 2, 20)
    assert "Window" not in found._jdf.queryExecution().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_distance_of_long_lines_takes_few_comparisons(monkeypatch):
    rng, calls, one = random.Random(12), [], L.common
    monkeypatch.setattr(L, "common", lambda a, b, i, j: calls.append(one(a, b, i, j)) or calls[-1])
    for alphabet in ("ab", "abcdefgh é\U0001f600"):
        for length in (0, 1, 30, 120, 400):
            a = "".join(rng.choice(alphabet) for _ in range(length))
            for n in range(0, 13, 3):
                b = changed(rng, a, n) if a else "x" * n
                d = brute.edit_distance(a, b)
                assert [L.distance_within(x, y, t) for x, y in ((a, b), (b, a)) for t in range(14)] == [d <= t for _ in range(2) for t in range(14)]
    long = "".join(rng.choice("abcdefgh ") for _ in range(6_000))
    far = changed(rng, long, 60)
    calls.clear()
    assert not L.distance_within(long, far, 20) and len(calls) <= 20**2 + 1  # by places of one line, there were 6,000 columns


def test_bags_of_lines_that_repeat():
    texts, line = ["abc" * 9, "abd" * 9, "", "é" * 30], [3, 0, 0, 1, 2, 1]
    every, distinct, n = L.Bags([texts[i] for i in line], 2), L.Bags(texts, 2, line), np.arange(len(line))
    assert all(distinct.possible(x, n).tolist() == every.possible(x, n).tolist() for x in range(len(line)))


def test_texts_of_lines_are_fetched_once(spark, monkeypatch):
    """Lines that are compared in the second round are among those of the first, whose texts are there already."""
    names, one = [], L.written
    monkeypatch.setattr(L, "written", lambda df, name="stage": names.append(name) or one(df, name))
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdefghijkl ") for _ in range(16)) for _ in range(30)]
    texts = [s + "".join(rng.choice("mnopqr") for _ in range(8)) for s in stems for _ in range(4)]
    texts += [changed(rng, t, 1) for t in texts[::3]]
    L.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert names.count("texts") == names.count("lines") == 1


def test_segments_of_a_class_are_made_once(monkeypatch):
    calls, one = [], L.mixed
    lines = L.HashedLines(["\n".join("abcdefgh é"[i % 10] * 7 + str(i) * 20 for i in range(40))])
    first = [x.tolist() for pair in L.keys_of(lines, np.arange(40), 2) for x in pair]
    monkeypatch.setattr(L, "mixed", lambda x: calls.append(len(x)) or one(x))
    assert [x.tolist() for pair in L.keys_of(lines, np.arange(40), 2) for x in pair] == first
    classes = {c for c in L.classes(int(lines.lengths.max()), 2) if c[1] >= 20}
    assert len(calls) <= 1 + 2 * len(classes)  # the lines' numbers, and one array of keys for each class and reach
