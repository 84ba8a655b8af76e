"""Queries of this package on the smallest tables, and the pipeline's stages on planted rows."""

import brute
import pytest
from compare import compare, duck
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm.queries import QUERIES, SQL
from corpusflow.session import written


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_has_a_row_for_each_input(spark, name):
    rows = QUERIES[name](spark, SF)
    table = {"op3": "pages", "op6": "conversations", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    expected = source.select("conv_id").distinct().count() + 1 if table == "conversations" else source.count()
    assert rows.count() == expected


def test_stages_keep_clean_documents(spark, tmp_path):
    filler = [" ".join(f"{w}{i}" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for i in range(40)]
    passage = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, "\n".join(filler[4 * i : 4 * i + 4]), "en") for i in range(8)]
    rows += [(20, rows[0][1], "en"), (21, rows[1][1] + " more", "en"), (22, filler[36] + " " + passage, "en"), (23, None, None), (24, "", "en"), (25, filler[38], "en"), (25, filler[38], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        assert docs.columns[:3] == ["doc_id", "text", "lang"]
    clean = list(range(8))
    assert kept["quality"] == sorted(r[0] for r in rows)  # no labels: nothing is rejected
    assert kept["line_dedup"] == [*clean, 21, 22, 23, 24, 25, 25]
    assert kept["near_dedup"] == [*clean, 21, 22, 23, 24, 25]
    assert kept["decontamination"] == kept["bpe"] == [*clean, 21, 23, 24, 25]
    assert docs.where("doc_id = 0").select(F.size("tokens")).first()[0] > 40


def test_stages_take_hard_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1) for i, t in brute.HARD], "doc_id long, text string, c0 int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(4, 1), (5, 0), (None, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "c0", "tokens"] and out.count() >= 1


def test_short_own_lines_between_repeated_ones_stay(spark):
    shared = ["all rights reserved by the owners of it", "this line of a license stands in many"]
    poem = "a rose\nis a rose\n\nof its own"
    rows = [(1, "\n".join(shared)), (2, f"{shared[0]}\n{poem}\n{shared[1]}"), (3, f"{shared[1]}\n \n\t"), (4, " \n"), (5, None)]
    out = corpus_pipeline.lines_once(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: poem, 4: " \n", 5: None}


def test_different_texts_of_one_id_are_different_documents(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(50))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a") + " more"), (None, text("c")), (None, text("c")), (None, text("d")), (3, ""), (3, None)]
    out = corpus_pipeline.one_per_group(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "")
    assert out.columns == ["doc_id", "text"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (3, ""), (3, None)], key=str)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    kinds = {"documents": "doc_id long, text string, lang string, n_chars long", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "tokens"] and out.count() == 0


def test_a_step_forgets_what_others_kept_in_the_worker():
    import pyarrow as pa

    from corpusflow.llm.texts import slices
    from corpusflow.session import kept_by_worker

    texts = pa.RecordBatch.from_pydict({"text": ["a", "b"]})
    kept_by_worker("bpe", "one", lambda: "words")
    kept_by_worker("other", "one", lambda: "many rows")
    assert [b.num_rows for b in slices([texts], keeps=("bpe",))] == [2]
    assert kept_by_worker("bpe", "one", lambda: "made again") == "words"
    assert kept_by_worker("other", "one", lambda: "made again") == "made again"
    assert [b.num_rows for b in slices([texts])] == [2]
    assert kept_by_worker("bpe", "one", lambda: "made again") == "made again"
