import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import quality as Q


def texts(rng, good, n):
    out = []
    for _ in range(n):
        base = [rng.choice("lorem ipsum dolor sit amet consetetur elitr sed diam".split()) for _ in range(rng.randrange(1, 300))]
        out.append(" ".join(base) + "." if good else "!! ".join(w.upper() for w in base) if rng.random() < 0.5 else " ".join(base[:6] * 9) + " $$$")
    return out


def fixture(rng, n):
    good, bad = texts(rng, True, n), texts(rng, False, n)
    return good + bad, [1] * n + [0] * n


def test_gradients_are_those_of_the_loss():
    rng = random.Random(1)
    x, before = Q.passages(pa.array(texts(rng, True, 3) + texts(rng, False, 3)))
    y = np.array([1, 1, 1, 0, 0, 0], float)
    model = Q.fitted(x, before, y, epochs=1)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    loss = lambda: -np.mean(np.where(y == 1, np.log(p := model.scores(x, before)), np.log(1 - p)))  # noqa: E731, F841
    for name, grad in model.gradients(x, before, y, 0).items():
        w = model.weights[name]
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(grad[at], rel=2e-2, abs=1e-6)
        w[at] += 1e-5


def test_held_out_accuracy(spark):
    train, labels = fixture(random.Random(2), 150)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = Q.fit(docs, marks)
    test, truth = fixture(random.Random(3), 60)
    out = Q.scored(spark.createDataFrame([(i, t, "s") for i, t in enumerate(test)], "doc_id long, text string, score string"), model)
    hits = [(r[3] >= 0.5) == truth[r["c0"]] for r in out.collect()]
    assert np.mean(hits) > 0.95


def test_hard_rows_and_missing_labels(spark):
    docs = spark.createDataFrame(brute.HARD, "doc_id long, text string")
    for rows in ([], [(4, 1)], [(4, 1), (5, 0)]):
        model = Q.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        scores = [r["score"] for r in Q.scored(docs, model).collect()]
        assert len(scores) == len(brute.HARD) and all(0 <= s <= 1 for s in scores)
    assert Q.scored(docs.limit(0), model).count() == 0


def test_passages_cover_whole_texts():
    x, before = Q.passages(pa.array(["w " * 130, "", None, "a"]))
    assert np.diff(before).tolist() == [3, 1, 1, 1] and not x[3].any() and x[5].any()
