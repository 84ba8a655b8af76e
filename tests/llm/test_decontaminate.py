import random
import time

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate as D


def expected(text, items):
    w = brute.words(text, brute.ALNUM)
    hit, found = set(), set()
    for item, item_text in items:
        v = brute.words(item_text, brute.ALNUM)
        for i in range(max(1, len(v) - 12) if v else 0):
            part = v[i : i + 13]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [10**7, 300])
def test_hits_equal_brute_force(spark, block_bytes):
    rng = random.Random(6)
    draw = lambda n: [rng.choice(["a", "B", "c,", "é", "d1"]) for _ in range(n)]
    items = [(i, " ".join(draw(n))) for i, n in enumerate([2, 5, 12, 13, 14, 30, 40, 0, 13])] + [(90, None), (91, ""), (92, "!!"), (8, "a a a a a a a a a a a a a a")]
    docs = []
    for i in range(40):
        text = draw(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            source = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(source))
            text[rng.randrange(len(text) + 1) : 0] = source[a : a + rng.randrange(1, 40)]
        docs.append((i, " ".join(text)))
    docs += brute.HARD
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_words int")
    got = D.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    rows = sorted(got.select(F.col("c0"), F.col("c1"), "n_words", "n_hit", "item_ids", "contaminated").collect(), key=str)
    want = sorted([(i, t, *expected(t, items)) for i, t in docs if t is not brute.LONG], key=str)
    assert [tuple(r) for r in rows if r[1] is not None and len(r[1]) < 10_000 or r[1] is None] == [r for r in want if r[1] is None or len(r[1]) < 10_000]
    assert len(rows) == len(docs)


def test_clean_rows_stay_unchanged(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, "l"), (2, "other text", "l"), (3, None, "l")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    kept = D.without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert D.without_contaminated(docs, items.limit(0)).count() == 3


@pytest.mark.parametrize("period", [1, 2, 3, 5, 6, 7, 9, 14])
def test_repeated_words_equal_brute_force(period):
    rng = random.Random(period)
    base = [f"w{i}" for i in range(period)]
    said = lambda n: [base[(i + rng.randrange(2) * (rng.random() < 0.01)) % period] for i in range(n)]
    for _ in range(12):
        item = said(rng.randrange(13, 60)) + ["x"] * rng.randrange(2) + said(rng.randrange(0, 40))
        text = ["y"] * rng.randrange(3) + said(rng.randrange(5, 80)) + ["x"] * rng.randrange(2) + said(rng.randrange(0, 60))
        index = D.ItemIndex([1], [" ".join(item)], 13, D.GRAM)
        words, counts = D.hashed_words(pa.array([" ".join(text)]))
        got = {w for _, a, b in index.hits(words, counts) for w in range(a, b)}
        windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
        assert got == {w for i in range(len(text) - 12) if tuple(text[i : i + 13]) in windows for w in range(i, i + 13)}


@pytest.mark.parametrize("said", ["again ", "once more "])
def test_the_same_over_and_over_takes_no_square_of_it(said):
    index = D.ItemIndex([1], [said * 10_000], 13, D.GRAM)
    words, counts = D.hashed_words(pa.array([said * 10_000]))
    started = time.process_time()
    got = index.hits(words, counts)
    assert time.process_time() - started < 4 and min(a for _, a, _ in got) == 0 and max(b for _, _, b in got) == len(words)
