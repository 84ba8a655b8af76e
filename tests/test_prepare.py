"""Datasets by name: reading, mixing by strategy, splits by stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import prepare as P
from corpusflow.operators.ordering import id_chunk
from corpusflow.sources.registry import DatasetSpec


def test_subset_and_folder_reach_the_reader(spark, tmp_path):
    for name, n in (("a/x", 2), ("a/y", 3)):
        spark.range(n).write.parquet(str(tmp_path / name))
    spec = DatasetSpec(name="a", location="a", subset="y")
    assert P.load_dataset(spark, spec, str(tmp_path)).count() == 3
    with pytest.raises(ValueError, match="not a file"):
        P.load_dataset(spark, DatasetSpec(name="hub", load_from="hf_hub", location="x"), str(tmp_path))


def test_wrong_checksums_are_an_error(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"x": 1}\n')
    good = hashlib.sha1((tmp_path / "d.jsonl").read_bytes()).hexdigest()
    for sha, ok in ((good, True), ("0" * 40, False)):
        registry = spark.createDataFrame([("d.jsonl", sha)], "location string, file_sha1 string")
        spec = DatasetSpec(name="d", location="d.jsonl", file_sha1=sha)
        if ok:
            assert P.load_dataset(spark, spec, str(tmp_path), registry=registry).count() == 1
        else:
            with pytest.raises(ValueError, match="checksum"):
                P.load_dataset(spark, spec, str(tmp_path), registry=registry)


def test_mix_and_split_by_name(spark):
    rows = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("d"))
    assert P.mix(rows, "d", "id", id_chunk("id"), "concat").count() == 10
    assert sorted(r["slot"] for r in P.mix(rows, "d", "id", id_chunk("id"), "interleave_over").collect()) == list(range(10))
    with pytest.raises(ValueError, match="strategy"):
        P.mix(rows, "d", "id", id_chunk("id"), "zip")
    with pytest.raises(ValueError, match="streams"):
        P.mix(rows, "d", "id", id_chunk("id"), "interleave_under", streaming=True)
    parts = P.split(rows, "id", "sft", val_size=3)
    assert (parts["train"].count(), parts["test"].count()) == (7, 3)
    assert list(P.split(rows, "id", "predict")) == ["test"]
    assert sorted(r["slot"] for r in P.split(rows, "id", "sft", shuffle=True)["train"].collect()) == list(range(10))
