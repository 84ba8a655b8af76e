import random

import brute
import pytest

from corpusflow.llm import near_dedup as N

SCHEMA = "doc_id long, text string"


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA + ", kept string")
    return N.near_duplicates(docs, **options).collect()


@pytest.mark.parametrize("shingle", [4, 5])
def test_components_equal_brute_force(spark, shingle):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]  # shared by many, a link for few
    rows = []
    for group in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(6, 120))] + passage * (group % 2)
        for _ in range(rng.randrange(1, 14)):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10**9), " ".join(text)))
    expected = brute.near_components(dict(rows), shingle, 80)
    got = result(spark, rows, shingle=shingle, percent=80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_of_members_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"v{rng.randrange(300)}" for _ in range(60)]
    rows = []
    for i in range(60):  # a chain: neighbours are near, ends are not
        base[i % 60] = f"new{i}"
        rows.append((i, " ".join(base)))
    expected = brute.near_components(dict(rows), 4, 80)
    monkeypatch.setattr(N, "SKETCH_BLOCK", 5)
    monkeypatch.setattr(N, "TEXT_BLOCK", 4)
    monkeypatch.setattr(N, "PER_HUB", 3)
    got = result(spark, rows, shingle=4, percent=80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_hard_rows(spark):
    got = result(spark, brute.HARD)
    assert len(got) == len(brute.HARD)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by_id[10]["component_id"] == 4 and by_id[9]["component_id"] == 8 and by_id[1]["component_id"] == 1
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_overlap_is_rarely_missed():
    assert 0 < N.least_overlap(96, 80) < 0.8 * 96
    assert N.least_overlap(1, 80) == 0
