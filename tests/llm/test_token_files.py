import zlib
from glob import glob

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import queries
from corpusflow.llm import token_files as S

END = 2
HARD_TEXTS = [
    "", None, "  ", "ΑΣ ΟΔΟΣ Σ.", "a<|endoftext|>B<|startoftext|>", "X<|STARTOFTEXT|>x", "<|endoftext", "İstanbul ﬁ ①②٣", "é ́x Å", "tab\x1cx\x85y",
    "it's WE'LL don't''s", "日本語テスト🙂", "\x00\x01\x7f", "0123456789" * 20,
]


@pytest.fixture(scope="module")
def library():
    found = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer_path())
    return found


def want(library, rows):
    """(id, start, ids) in ascending order of id, nulls first."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, END]
        out.append((i, at, ids))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def store(spark, library, tmp_path_factory):
    rows = [(i * 37 % 400, t) for i, t in enumerate(HARD_TEXTS)] + [(500 + i, f"text {i} of many " * (i % 50)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, i % 3, f"m{i}") for i, t in rows], "doc_id long, text string, part int, tokens string").repartition(5)
    path = str(tmp_path_factory.mktemp("store") / "s")
    S.write_tokens(docs, path, queries.definition(queries.tokenizer_path()), END, meta=["part", "tokens"], file_bytes=20_000, row_group_bytes=20_000)
    return path, want(library, rows)


def test_files_equal_the_library(spark, store):
    path, expected = store
    got = S.read_tokens(spark, path, ["doc_id", "start", "n_tokens", "tokens", "meta"]).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["tokens"]) for r in got] == expected
    assert all(r["n_tokens"] == len(r["tokens"]) and tuple(r["meta"]) == (r["doc_id"] % 3, f"m{r['doc_id']}") for r in got)
    files = sorted(glob(f"{path}/data/part-*"))
    assert len(files) > 3
    assert [i for f in files for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()] == [e[0] for e in expected]


def test_encodings_and_indexes(store):
    groups = 0
    for f in glob(f"{store[0]}/data/part-*"):
        found = pq.ParquetFile(f).metadata
        groups += found.num_row_groups
        for g in range(found.num_row_groups):
            columns = {c.path_in_schema: c for c in (found.row_group(g).column(i) for i in range(found.num_columns))}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
            assert {"DELTA_BINARY_PACKED"} == set(columns["doc_id"].encodings) - {"RLE", "BIT_PACKED"}
            assert columns["at"].statistics.has_min_max
    assert groups >= len(glob(f"{store[0]}/data/part-*"))


def test_row_groups_are_bounded(spark, tmp_path):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.hash(i, "id").cast("string"))).alias("text"))
    S.write_tokens(docs.coalesce(1), str(tmp_path / "s"), queries.definition(queries.tokenizer_path()), END, file_bytes=10**9, row_group_bytes=500_000)
    sizes = [pq.ParquetFile(f).metadata.num_row_groups for f in glob(str(tmp_path / "s/data/part-*"))]
    assert min(sizes) >= 2


def test_selective_reads(spark, store):
    path, expected = store
    flat = [x for _, _, ids in expected for x in ids]
    for first, last in ((0, 1), (3, 40), (0, len(flat)), (len(flat) - 5, len(flat) + 9), (700, 701), (10, 10), (-4, 3), (len(flat), len(flat) + 1)):
        got = S.read_range(spark, path, first, last).orderBy("start").collect()
        assert [x for r in got for x in r["tokens"]] == flat[max(first, 0) : max(last, 0)], (first, last)
        at = max(first, 0)
        for r in got:
            assert r["start"] == at
            at += len(r["tokens"])
    some = S.read_tokens(spark, path, ["doc_id", "n_tokens"], low=510, high=520)
    assert sorted(tuple(r) for r in some.collect()) == [(i, len(ids)) for i, _, ids in expected if 510 <= i <= 520]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id)" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]


def test_hard_rows(spark, library, tmp_path):
    docs = spark.createDataFrame(brute.HARD, "doc_id long, text string")
    definition = queries.definition(queries.tokenizer_path())
    S.write_tokens(docs.repartition(3), str(tmp_path / "a"), definition, END)
    got = S.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["tokens"]) for r in got] == want(library, brute.HARD)
    S.write_tokens(docs.limit(0), str(tmp_path / "b"), definition, END)
    assert S.read_tokens(spark, str(tmp_path / "b")).count() == 0 and S.read_range(spark, str(tmp_path / "b"), 0, 5).count() == 0


def test_memory_of_pieces_is_bounded(library, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 10)
    encoder = S.PieceEncoder(queries.definition(queries.tokenizer_path()))
    for n in range(20):
        texts = [f"word{n} and word{n + 1} and the rest{k}" for k in range(4)]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) < 30 and len(encoder.known.before) < 30 and len(encoder.words.before) < 30


def test_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(HARD_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_token_files"](spark, str(tmp_path)).collect()
    expected = [(i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, at, ids in want(library, rows)]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected


def test_new_words_go_to_the_library_together(library, monkeypatch):
    encoder = S.PieceEncoder(queries.definition(queries.tokenizer_path()))
    assert encoder.plain
    calls, one = [], encoder._word
    monkeypatch.setattr(encoder, "_word", lambda word: calls.append(word) or one(word))
    texts = [None, *[" ".join(f"{a}{b}ziéß{a}," for b in "abcdeöñ") + f" {a}{a}È ab{a}" for a in "abcdefghij"], "", "x<|endoftext|>Y", "it's ÄÖ x\x85y é é9."]
    column = pa.chunked_array([pa.array(["cut off", *texts])]).slice(1).combine_chunks()  # an array that starts within its buffers
    ids, sizes = encoder.encode_column(column)
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(calls) < 30  # of 94 different pieces


def test_words_of_letters_are_looked_up_by_arrow(library, monkeypatch):
    encoder = S.PieceEncoder(queries.definition(queries.tokenizer_path()))
    words = [f"{a}{b}{c}ß" for a in "abcdefgh" for b in "ijklöé" for c in "mnopqrst"]
    texts = ["", " ".join(w + s for w in words for s in ("", ",", '."', "-")), " ".join(words[:9]), "it's x9, ... <|endoftext|>Ab 日本 -", None]
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (S.REMEMBERED, 7, 0):
        monkeypatch.setattr(S, "REMEMBERED", most)
        for _ in range(2):  # with the words of before, too
            ids, sizes = encoder.encode_column(pa.array(texts))
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted
        assert len(encoder.seen) == len(encoder.seen_ids) <= most
    assert len(encoder.known) + len(encoder.known.before) < 20  # not the 1,536 words with and without signs
    plain = np.concatenate([encoder.encode_column(pa.array([t]))[0] for t in ("", "  ", None)])
    assert plain.tolist() == []
