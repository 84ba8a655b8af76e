"""Streams that arrive in several micro-batches give the same results as the batch operators."""

import collections
import datetime
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.examples import pack_pretrain
from corpusflow.operators.mixing import buffered_shuffle, interleave_probs, interleave_under
from corpusflow.operators.ordering import id_chunk
from corpusflow.operators.retention import retain_sink_recent
from corpusflow.streaming import streams as X
from corpusflow.streaming.state import KeyedCounts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "user long, id long, v double"


@pytest.fixture
def source(spark, tmp_path):
    rng = random.Random(9)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(6), i, rng.random()) for i in range(600)]
    path = str(tmp_path / "src")
    for b in range(4):
        spark.createDataFrame(rows[b * 150 : (b + 1) * 150], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def read(spark, path):
    return X.stream_dataset(spark, path, SCHEMA, max_files=1)


def pairs(df):
    return sorted((r["user"], r["id"]) for r in df.collect())


def test_retained_state_equals_batch(spark, source):
    path, rows = source
    chunk, queries = id_chunk("id", 50), []
    changes = X.collect_stream(X.stream_retain(read(spark, path), ["user"], ["id"], F.xxhash64("id"), 3, 3, 5), "r", queries=queries)
    assert changes.select("batch_id").distinct().count() >= 4
    batch = retain_sink_recent(spark.createDataFrame(rows, SCHEMA), ["user"], ["id"], 3, 5, chunk)
    kept = pairs(X.retained_view(changes, ["user"], ["id"], 3, 5, chunk))
    assert kept == pairs(batch)
    assert sorted(kept + pairs(X.evicted_view(changes, ["user"], ["id"], 3, 5, chunk))) == sorted((u, i) for u, i, _ in rows)
    # changes only: a row is kept once and evicted once at most
    assert changes.groupBy("user", "id", "change").count().where("count > 1").count() == 0
    assert X.late_rows(queries[0]) == 0


def test_retaining_needs_no_settings(tmp_path):
    """In a session that sets nothing."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
from corpusflow.operators.ordering import id_chunk
from corpusflow.streaming import streams as X
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.range(100).selectExpr("id % 3 AS user", "id").write.parquet("src")
events = X.stream_dataset(spark, "src", "user long, id long")
changes = X.collect_stream(X.stream_retain(events, ["user"], ["id"], F.lit(0), 1, 2, 3), "r")
print("KEPT", X.retained_view(changes, ["user"], ["id"], 2, 3, id_chunk("id")).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "KEPT 15" in done.stdout, done.stderr[-2000:]


def test_idle_states_go_and_late_rows_are_counted(spark, tmp_path):
    path, out = str(tmp_path / "src"), str(tmp_path / "out")
    minutes = [[(1, i, i) for i in range(10)] + [(2, 100 + i, i) for i in range(10)], [(1, 200 + i, 500 + i) for i in range(4)], [(2, 300, 3), (2, 301, 700), (1, 302, 505)], [(1, 400, 1200)]]
    kinds = "user long, id long, ts timestamp"
    queries, state = [], []
    for batch in minutes:
        rows = [(u, i, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=m)) for u, i, m in batch]
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(path)
        events = X.stream_dataset(spark, path, kinds)
        retained = X.stream_retain(events, ["user"], ["ts", "id"], F.lit(0), 1, 1, 2, ts="ts", delay="10 minutes", idle_seconds=3600)
        changes = X.collect_stream(retained, "r", path=out, queries=queries)
        state.append(queries[-1].recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    late = sum(map(X.late_rows, queries))
    assert late == 1  # (2, 300) came at minute 3 after minute 503 was seen
    chunk = F.floor(F.unix_seconds("ts") / 3600)
    kept = pairs(X.retained_view(changes, ["user"], ["ts", "id"], 1, 2, chunk))
    assert kept == [(1, 0), (1, 302), (1, 400), (2, 100), (2, 109), (2, 301)]
    gone = pairs(X.evicted_view(changes, ["user"], ["ts", "id"], 1, 2, chunk))
    assert sorted(kept + gone) == sorted((u, i) for b in minutes for u, i, _ in b if i != 300)
    assert state[1] == 1  # user 2 was idle for more than an hour


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out = str(tmp_path / "src"), str(tmp_path / "out")
    chunk = id_chunk("id", 32)
    runs = {
        "plain": lambda: X.collect_stream(read(spark, path).select("id"), "p", path=f"{out}/plain"),
        "sample": lambda: X.stream_sample_every(read(spark, path), ["user"], ["id"], 3, chunk, path=f"{out}/sample"),
        "split": lambda: X.stream_take_skip(read(spark, path), ["id"], 70, chunk, path=f"{out}/split"),
        "shuffle": lambda: X.stream_shuffle(read(spark, path).select("id"), "id", 5, 64, path=f"{out}/shuffle"),
        "mixed": lambda: X.stream_interleave(read(spark, path).select("user", "id"), "user", 3, ["id"], chunk, path=f"{out}/mixed"),
    }
    rows = [(i % 3, i, 0.0) for i in range(200)]
    for a in (0, 50, 120):  # nothing new in the last round
        part = rows[a : {0: 50, 50: 120, 120: 120}[a]]
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = {name: run() for name, run in runs.items()}
        seen = rows[: {0: 50, 50: 120, 120: 120}[a]]
        assert sorted(r["id"] for r in got["plain"].collect()) == [i for _, i, _ in seen]
        assert sorted(r["pos"] for r in got["sample"].where("user = 1").collect()) == list(range(2, sum(u == 1 for u, _, _ in seen), 3))
        assert sorted(r["id"] for r in got["split"].where("split = 'test'").collect()) == list(range(min(70, len(seen))))
        assert got["split"].count() == len(seen)
        want = buffered_shuffle(spark.createDataFrame([(i, i) for _, i, _ in seen], "id long, n long"), "n", "id", 5, 64)
        assert sorted((r["id"], r["slot"]) for r in got["shuffle"].collect()) == sorted((r["id"], r["slot"]) for r in want.collect())
        least = min(sum(u == d for u, _, _ in seen) for d in range(3))
        assert sorted(r["slot"] for r in got["mixed"].collect()) == list(range(3 * least))


def test_counts_write_what_changed(spark, tmp_path):
    kinds = T.StructType.fromDDL("user long, n long")
    counts = KeyedCounts(spark, str(tmp_path / "c"), kinds.fields[:1], fold=3)
    want, sizes = collections.Counter(), []
    for b in range(20):
        new = {u: 1 + u for u in range(1000)} if b == 0 else {b: 5, 0: 1}
        keys = spark.createDataFrame(list(new.items()), kinds)
        assert {r["user"]: r["n"] for r in counts.before(b, keys).collect()} == {u: want[u] for u in new if u in want}
        counts.add(b, keys)
        want.update(new)
        sizes.append(spark.read.parquet(*[str(tmp_path / "c" / f"0-{b}")]).count())
        assert len(counts.pieces(b + 1)) <= 2 * 3
    assert {r["user"]: r["n"] for r in counts.before(20).collect()} == dict(want)
    assert sizes[1:] == [2] * 19
    assert counts.pieces(0) == [] and counts.pieces(20) == [(0, 18), (0, 19), (2, 0), (2, 1)]


@pytest.mark.parametrize("files", [1, 3, 100])
def test_shuffle_and_packing_do_not_depend_on_triggers(spark, tmp_path, files):
    path = str(tmp_path / "src")
    for b in range(5):
        spark.createDataFrame([(i, list(range(i % 7))) for i in range(b * 30, b * 30 + 30)], "id long, ids array<int>").coalesce(1).write.mode("append").parquet(path)
    stream = X.stream_dataset(spark, path, "id long, ids array<int>", max_files=files)
    got = X.stream_shuffle(stream.select("id"), "id", 3, buffer=40).select("id", "slot")
    want = buffered_shuffle(spark.range(150).withColumn("n", F.col("id")), "n", "id", 3, 40).select("id", "slot")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    table = spark.read.parquet(path)
    packed = X.stream_pack(stream, "ids", "id", 8, id_chunk("id"), batch_rows=25).drop("batch_id")
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, pack_pretrain(table, "ids", "id", 8, batch_rows=25).collect()))


@pytest.mark.parametrize("files", [1, 2, 100])
def test_interleaving_equals_the_table(spark, tmp_path, files):
    path, rng = str(tmp_path / "src"), random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 1, 2]) if i > 60 else 0, i) for i in range(200)]
    for b in range(5):
        spark.createDataFrame(rows[b * 40 : b * 40 + 40], "d int, id long").coalesce(1).write.mode("append").parquet(path)
    table, chunk = spark.createDataFrame(rows, "d int, id long"), id_chunk("id", 16)
    stream = X.stream_dataset(spark, path, "d int, id long", max_files=files)
    for probs in (None, [0.2, 0.5, 0.3]):
        got = X.stream_interleave(stream, "d", 3, ["id"], chunk, probs, 7).select("d", "id", "slot")
        want = interleave_under(table, "d", "id", chunk) if probs is None else interleave_probs(table, "d", "id", chunk, probs, 7)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("d", "id", "slot").collect()))


def test_sampling_counts_across_batches(spark, source):
    path, rows = source
    out = X.stream_sample_every(read(spark, path), ["user"], ["id"], 10, id_chunk("id", 32))
    assert out.select("batch_id").distinct().count() >= 4
    # Files may arrive in any order: every stream still has every tenth position exactly once.
    got = {}
    for r in out.collect():
        got.setdefault(r["user"], []).append(r["pos"])
    sizes = {u: sum(r[0] == u for r in rows) for u in {r[0] for r in rows}}
    assert {u: sorted(p) for u, p in got.items()} == {u: list(range(9, n, 10)) for u, n in sizes.items() if n >= 10}


def test_take_and_skip(spark, source):
    path, rows = source
    out = X.stream_take_skip(read(spark, path), ["id"], 200, id_chunk("id", 32)).collect()
    assert len(out) == 600 and sum(r["split"] == "test" for r in out) == 200


def test_perplexity_and_union(spark, source):
    path, rows = source
    out = X.collect_stream(X.stream_perplexity(read(spark, path), ["user"], "v"), "p", "update")
    last = out.groupBy("user").agg(F.max_by("nll_sum", "batch_id").alias("s"), F.max("num_eval_tokens").alias("n")).collect()
    for r in last:
        mine = [x[2] for x in rows if x[0] == r["user"]]
        assert r["s"] == pytest.approx(sum(mine)) and r["n"] == len(mine)
    both = X.collect_stream(X.stream_union([read(spark, path), read(spark, path)]), "u")
    assert both.groupBy("dataset_idx").count().collect()[0]["count"] == 600


def test_argument_checks(spark, tmp_path):
    for kwargs, text in (({"max_samples": 5}, "max_samples"), ({"val_size": 0.1}, "number of rows, not a share"), ({"training": True}, "max_steps")):
        with pytest.raises(ValueError, match=text):
            X.stream_dataset(spark, str(tmp_path), SCHEMA, **kwargs)


def test_many_streams_share_states(spark, tmp_path):
    """A state holds parts of several streams; each keeps its own first and last rows, texts as order keys, too."""
    path = str(tmp_path / "src")
    rows = [(u, f"{i:03d}") for u in range(60) for i in range(u % 9)]
    spark.createDataFrame(rows, "user long, id string").coalesce(1).write.parquet(path)
    events = X.stream_dataset(spark, path, "user long, id string")
    shared, X.BUCKETS = X.BUCKETS, 3
    try:
        changes = X.collect_stream(X.stream_retain(events, ["user"], ["id"], F.lit(0), 1, 2, 3), "shared")
    finally:
        X.BUCKETS = shared
    got = sorted((r["user"], r["id"], r["change"], r["seen"]) for r in changes.collect())
    assert got == sorted((u, i, "kept" if int(i) < 2 or int(i) >= u % 9 - 3 else "evicted", u % 9) for u, i in rows)
    kept, gone = X.both_views(changes, ["user"], ["id"], 2, 3, F.col("user"))
    assert kept.count() + gone.count() == len(rows) and gone.count() == sum(max(u % 9 - 5, 0) for u in range(60))
