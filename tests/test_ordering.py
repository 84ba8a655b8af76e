"""Positions, running totals and medians with chunks far smaller than the groups."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import ordering as O


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # One group holds a third of all rows.
    return [(i, "hot" if i % 3 == 0 else f"g{rng.randrange(20)}", rng.randrange(50) / 4) for i in range(3000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(7)


def by_group(rows):
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_positions(df, rows, width):
    got = {r["id"]: (r["pos"], r["n"]) for r in O.positions(df, ["g"], ["id"], O.id_chunk("id", width), total="n").collect()}
    expected = {r[0]: (i, len(g)) for g in by_group(rows).values() for i, r in enumerate(g)}
    assert got == expected


def test_positions_keep_prunes_but_keeps_numbers(df, rows):
    out = O.positions(df, ["g"], ["id"], O.id_chunk("id", 50), keep=lambda base, n, total: base + n > total - 5)
    got = {r["id"]: r["pos"] for r in out.collect()}
    expected = {r[0]: i for g in by_group(rows).values() for i, r in enumerate(g)}
    assert all(expected[i] == p for i, p in got.items())
    last = {r[0] for g in by_group(rows).values() for r in g[-5:]}
    assert last <= set(got)


def test_global_positions_and_even_chunks(spark):
    ids = [i**3 for i in range(500)]  # ids far from evenly spread
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    chunk = O.even_chunk(df, "id", 50)
    sizes = [r["count"] for r in df.groupBy(chunk.alias("c")).count().collect()]
    assert max(sizes) <= 60 and len(sizes) >= 9
    got = {r["id"]: r["pos"] for r in O.positions(df, [], ["id"], chunk).collect()}
    assert got == {v: i for i, v in enumerate(ids)}


@pytest.mark.parametrize("short", [False, True])
def test_running_total(df, rows, short):
    out = O.running_totals(df, {"t": "v"}, ["g"], ["id"], O.id_chunk("id", 40), mostly_short=short)
    got = {r["id"]: r["t"] for r in out.collect()}
    for g in by_group(rows).values():
        total = 0.0
        for r in g:
            total += r[2]
            assert got[r[0]] == pytest.approx(total)


def test_previous_value(df, rows):
    out = O.previous_value(df, "v", ["g"], ["id"], O.id_chunk("id", 11), "prev", pos="pos")
    got = {r["id"]: (r["prev"], r["pos"]) for r in out.collect()}
    for g in by_group(rows).values():
        assert [got[r[0]][0] for r in g] == [None] + [r[2] for r in g[:-1]]
        assert [got[r[0]][1] for r in g] == list(range(len(g)))


def test_first_rows_and_rest(df):
    chunk = O.id_chunk("id", 64)
    for n in (0, 1, 64, 65, 2999, 3000, 5000):
        head = {r["id"] for r in O.first_rows(df, ["id"], n, chunk).collect()}
        tail = {r["id"] for r in O.rows_after(df, ["id"], n, chunk).collect()}
        assert head == set(range(min(n, 3000))) and tail == set(range(min(n, 3000), 3000))


def test_exact_median(df, rows):
    got = {r["g"]: r["m"] for r in O.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(r[2] for r in rs) for g, rs in by_group(rows).items()}


def test_exact_median_of_a_group_larger_than_the_sketch(spark):
    values = [(("a" if i % 4 else "b"), float((i * 7919) % 30011)) for i in range(60_000)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r["g"]: r["m"] for r in O.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(v for k, v in values if k == g) for g in "ab"}


def test_unit_hash_is_uniform(spark):
    stats = spark.range(20_000).select(O.unit_hash(1, "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= stats[0] < 0.01 and 0.99 < stats[1] < 1 and abs(stats[2] - 0.5) < 0.01


@pytest.mark.parametrize("per_task", [1, 3, 4096])
def test_sums_over_runs_of_chunks(spark, per_task, monkeypatch):
    monkeypatch.setattr(O, "CHUNKS_PER_TASK", per_task)
    rows = [(i * i % 997 - 300, i % 5) for i in range(400)]
    rows = sorted({k: v for k, v in rows}.items())  # also negative chunks, and chunks without rows
    df = spark.createDataFrame(rows, "id long, v int").repartition(6)
    placed = O.positions(df, [], ["id"], F.floor(F.col("id") / 7).cast("long"), total="n").orderBy("id").collect()
    assert [(r["id"], r["pos"], r["n"]) for r in placed] == [(k, i, len(rows)) for i, (k, _) in enumerate(rows)]
    summed = O.running_total(df, "v", [], ["id"], F.floor(F.col("id") / 7).cast("long"), "s", exclusive=True).orderBy("id").collect()
    assert [r["s"] for r in summed] == [sum(v for _, v in rows[:i]) for i in range(len(rows))]
    assert O.first_rows(df, ["id"], 33, F.floor(F.col("id") / 7).cast("long")).count() == 33
