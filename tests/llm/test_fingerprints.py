import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import fingerprints as P
from corpusflow.llm import neighbours, queries


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.2, 0.5, 0.9, 1.0):
        common = rng.integers(0, 2**63, int(600 * share))
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 600 - len(common))])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert P.likeness(P.fingerprint(a), P.fingerprint(b)) == pytest.approx(true, abs=0.12)


def test_short_and_empty_texts():
    marks = P.fingerprints(pa.array([None, "", " ", "one", "One", "two", "a b c d e f"]))
    assert marks[:3] == [b""] * 3 and marks[3] == marks[4]
    assert P.likeness(marks[3], marks[4]) == 1 and P.likeness(marks[0], marks[1]) == 1 and P.likeness(marks[0], marks[3]) == 0
    assert P.likeness(marks[3], marks[5]) < 0.2 and P.likeness(marks[3], marks[6]) < 0.2


@pytest.mark.parametrize("rows_per_chunk", [1, 3, 1000])
def test_next_row_in_the_whole_order(spark, rows_per_chunk):
    rows = [(i * 7 % 23, f"t{i}") for i in range(23)] + [(5, "t5b"), (None, "n1"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def pair(a, b):
        return pa.RecordBatch.from_arrays([a.column("doc_id"), a.column("text"), b.column("text")], ["doc_id", "text", "after"])

    out = neighbours.with_next(df, "doc_id", "doc_id long, text string, after string", pair, rows_per_chunk=rows_per_chunk)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = sorted(((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert neighbours.with_next(df.limit(0), "doc_id", "doc_id long, text string, after string", pair).count() == 0


def test_query_edits_every_text(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in brute.HARD if i is not None], "doc_id long, text string").distinct().write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_fingerprints"](spark, str(tmp_path)).collect()}
    docs = sorted({(i, t) for i, t in brute.HARD if i is not None}, key=lambda r: -r[0])
    for k, (i, text) in enumerate(docs):
        text, other = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
    assert got[4]["fingerprint"] == got[10]["fingerprint"]
