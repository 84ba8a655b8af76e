"""Structured Streaming versions of the batch operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.operators.examples import Encoding, attention_mask, encode_sft, pack
from corpusflow.operators.mixing import buffered_shuffle, drawn_slots
from corpusflow.operators.ordering import id_chunk, nth_key, positions
from corpusflow.session import broadcast_if_small, written
from corpusflow.streaming.state import Carry, KeyedCounts, folder, group_of, in_groups, run_through


def stream_dataset(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    max_files: int | None = None,
    max_samples: int | None = None,
    val_size: float = 0,
    max_steps: int = -1,
    training: bool = False,
) -> DataFrame:
    """STM-01: files read lazily as a stream, with the checks a streaming job needs."""
    if max_samples is not None:
        raise ValueError("a stream cannot be cut to max_samples rows")
    if 1e-6 < val_size < 1:
        raise ValueError("the validation part of a stream is a number of rows, not a share")
    if training and max_steps == -1:
        raise ValueError("training on a stream needs max_steps")
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drive a stream through everything available now and hand each micro-batch to ``sink``."""
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """Sink: one folder per micro-batch, replaced when a batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def collect_stream(df: DataFrame, name: str, mode: str = "append", path: str | None = None, queries: list[StreamingQuery] | None = None) -> DataFrame:
    """Run a stream to its end through files and read the result as a table.

    With ``path`` the results and the checkpoint stay there: a later call takes only what has arrived since, once, also
    after a run that broke off.  ``queries`` receives the query, for its progress.
    """
    path = folder(df.sparkSession, path, name)
    query = run_available(df, to_parquet(f"{path}/out"), f"{path}/checkpoint", mode)
    if queries is not None:
        queries.append(query)
    schema = T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])
    return df.sparkSession.read.schema(schema).parquet(f"{path}/out")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators left out because they were older than the watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


# States that the parts of all streams are dealt to.
BUCKETS = 4_096


def stream_retain(
    events: DataFrame, by: Sequence[str], order: Sequence[str], salt: Column, salts: int, start: int, recent: int,
    ts: str | None = None, delay: str = "0 seconds", idle_seconds: int | None = None,
) -> DataFrame:
    """STM-03: bounded state per stream, first ``start`` and last ``recent`` rows by order; what changed in each trigger.

    First-k and last-k can be merged, so a stream's state is split into ``salts`` parts, each kept by another task: a
    stream that carries a third of all events does not end up in one state.  A row comes out as ``kept`` when it enters
    the state and as ``evicted`` when it leaves it, or right away if it never stays over a trigger; ``seen`` counts the
    part's rows.  Parts are dealt to ``BUCKETS`` states, as a call to Python for each of very many short streams would take
    most of the time; a trigger writes the states of the buckets that it touches.  :func:`retained_view` and :func:`evicted_view` make the streams' rows of that.

    With ``idle_seconds``, the state of a part that had no row for so long, in event time (``ts``), is dropped, which changes
    neither view; rows that are late by more than ``delay`` are then left out and counted (:func:`late_rows`).  Any state
    store will do.  Order keys must be unique in a stream and not NULL.
    """
    import numpy as np
    import pandas as pd

    schema = events.schema
    names, order, part, limit = schema.names, list(order), [*by, "_salt"], start + recent
    out = T.StructType([*schema.fields, T.StructField("change", T.StringType()), T.StructField("seen", T.LongType())])
    salted = events.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    if idle_seconds is not None:
        salted = salted.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = pickle.loads(state.get[0]) if state.exists else None
        for frame in () if state.hasTimedOut else filter(len, frames):
            fresh = frame[[*names, "_salt"]].assign(change="kept", seen=0, _latest=0)
            if idle_seconds is not None:
                times = frame["_time"].to_numpy("datetime64[ms]")
                fresh["_latest"] = np.where(np.isnat(times), 0, times.astype("int64"))
            fresh["_new"] = 1
            pool = fresh if pool is None else pd.concat([pool, fresh], ignore_index=True)
            pool = pool.sort_values([*part, *order], ignore_index=True)
            parts = pool.groupby(part, dropna=False, sort=False)
            at, n = parts.cumcount(), parts["_new"].transform("size")
            pool["seen"] = parts["seen"].transform("max") + parts["_new"].transform("sum")
            pool["_latest"], pool["_new"] = parts["_latest"].transform("max"), 0
            gone = (n > limit) & (at >= start) & (at < n - recent)
            if gone.any():
                yield pool.loc[gone, names].assign(change="evicted", seen=pool.loc[gone, "seen"])
                pool = pool[~gone].reset_index(drop=True)
        if pool is None:
            return
        entered = pool["change"] == "kept"
        if entered.any():
            yield pool.loc[entered, [*names, "change", "seen"]]
        pool["change"] = ""
        if idle_seconds is not None:
            pool = pool[pool["_latest"] + 1000 * idle_seconds > state.getCurrentWatermarkMs()].reset_index(drop=True)
            if not len(pool):
                state.remove()
                return
        state.update((pickle.dumps(pool),))
        if idle_seconds is not None:
            state.setTimeoutTimestamp(max(int(pool["_latest"].min()) + 1000 * idle_seconds, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.EventTimeTimeout
    salted = salted.withColumn("_bucket", F.pmod(F.xxhash64(*by, "_salt"), F.lit(BUCKETS)).cast("int"))
    return salted.groupBy("_bucket").applyInPandasWithState(step, out, "kept binary", "append", timeout)


def _still_kept(changes: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that some part of a stream's state holds."""
    gone = changes.where("change = 'evicted'").select(*by, *order)
    kept = changes.where("change = 'kept'").drop("change", "seen", "batch_id")
    return kept.join(gone, [*by, *order], "left_anti").select(*kept.columns)


def retained_view(changes: DataFrame, by: Sequence[str], order: Sequence[str], start: int, recent: int, chunk: Column) -> DataFrame:
    """Kept rows of each stream as of now, from what :func:`stream_retain` gave out."""
    return _retained(_still_kept(changes, by, order), by, order, start, recent, chunk)


def _retained(kept: DataFrame, by: Sequence[str], order: Sequence[str], start: int, recent: int, chunk: Column) -> DataFrame:
    """The first and last rows of each stream's parts, which hold few rows together, so that a stream is one window.

    Rows without a group key or a chunk have no place in a stream.
    """
    group = Window.partitionBy(*by)
    at, n = F.row_number().over(group.orderBy(*order)) - 1, F.count(F.lit(1)).over(group)
    placed = kept.select("*", at.alias("_at"), n.alias("_n"))
    stays = (F.col("_n") <= start + recent) | (F.col("_at") < start) | (F.col("_at") >= F.col("_n") - recent)
    known = chunk.isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    return placed.where(stays & known).select(*kept.columns)


def evicted_view(changes: DataFrame, by: Sequence[str], order: Sequence[str], start: int, recent: int, chunk: Column) -> DataFrame:
    """All other rows of each stream as of now: those that left a part's state, and those that only their part still holds."""
    return both_views(changes, by, order, start, recent, chunk)[1]


def both_views(changes: DataFrame, by: Sequence[str], order: Sequence[str], start: int, recent: int, chunk: Column) -> tuple[DataFrame, DataFrame]:
    """:func:`retained_view` and :func:`evicted_view` of one state, which is put together once."""
    kept = written(_still_kept(changes, by, order), "held")
    view = written(_retained(kept, by, order, start, recent, chunk), "view")
    gone = changes.where("change = 'evicted'").select(*kept.columns)
    return view, gone.unionByName(kept.join(view.select(*by, *order), [*by, *order], "left_anti").select(*kept.columns))


def stream_sample_every(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, chunk: Column, path: str | None = None) -> DataFrame:
    """STM-04: every k-th record of each stream, with its position ``pos``.

    The number of rows seen per stream is a :class:`KeyedCounts`; positions inside a batch come from chunk offsets, so one
    busy stream is numbered by many tasks.
    """
    path, by = folder(df.sparkSession, path, "sample-every"), list(by)
    seen = KeyedCounts(df.sparkSession, f"{path}/counts", [df.schema[c] for c in by])

    def one(batch: DataFrame, batch_id: int) -> DataFrame:
        counts = seen.add(batch_id, batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
        before = broadcast_if_small(written(seen.before(batch_id, counts), "before").withColumnRenamed("n", "_base"))
        placed = positions(batch, by, order, chunk, "_at").join(before, by, "left")
        placed = placed.withColumn("pos", F.col("_at") + F.coalesce("_base", F.lit(0)))
        return placed.where((F.col("pos") + 1) % k == 0).select(*df.columns, "pos")

    return run_through(df, one, path, T.StructType([*df.schema.fields, T.StructField("pos", T.LongType())]))


def stream_take_skip(df: DataFrame, order: Sequence[str], n: int, chunk: Column, path: str | None = None) -> DataFrame:
    """STM-09: the first n records of the stream are validation, the others training (``split``).

    Of a micro-batch only the key of the last validation record is looked for; once n records have passed, nothing is.
    """
    path, all_ = folder(df.sparkSession, path, "take-skip"), T.StructField("_all", T.IntegerType())
    seen = KeyedCounts(df.sparkSession, f"{path}/counts", [all_])

    def one(batch: DataFrame, batch_id: int) -> DataFrame:
        left = n - sum(r["n"] for r in seen.before(batch_id).collect())  # one row
        size = batch.agg(F.lit(0).alias("_all"), F.count(F.lit(1)).alias("n")) if left > 0 else batch.limit(0).agg(F.lit(0).alias("_all"), F.lit(0).cast("long").alias("n"))
        seen.add(batch_id, size)
        if left <= 0:
            return batch.withColumn("split", F.lit("train"))
        last = nth_key(batch, order, left, chunk).scalar()
        return batch.withColumn("split", F.when(F.struct(*order) <= last, "test").otherwise("train"))

    return run_through(df, one, path, T.StructType([*df.schema.fields, T.StructField("split", T.StringType())]))


def stream_perplexity(tokens: DataFrame, by: Sequence[str], nll: str, pos: str | None = None, first_n: int | None = None) -> DataFrame:
    """STM-05: running sum and count of losses per stream (update mode); partial sums are formed before the shuffle."""
    rows = tokens if first_n is None else tokens.where(F.col(pos) < first_n)
    return rows.groupBy(*by).agg(F.sum(nll).alias("nll_sum"), F.count(nll).alias("num_eval_tokens"))


def stream_shuffle(df: DataFrame, key: str, seed: int, buffer: int = 16_384, order: Sequence[str] | None = None, chunk: Column | None = None, path: str | None = None) -> DataFrame:
    """STM-06: hash order inside consecutive buffers of ``buffer`` records; ``slot`` is the new number.

    A buffer that a micro-batch leaves unfinished waits for the next one, and the last goes out when the stream has ended:
    the slots are those of :func:`corpusflow.operators.mixing.buffered_shuffle`, see :func:`in_groups`.
    """
    order = [key] if order is None else list(order)
    chunk = id_chunk(order[0]) if chunk is None else chunk
    schema = T.StructType([*df.schema.fields, T.StructField("slot", T.LongType())])
    step = lambda rows: buffered_shuffle(rows, "_pos", key, seed, buffer).drop("_pos")
    return in_groups(df, order, chunk, buffer, step, schema, folder(df.sparkSession, path, "shuffle"))


def stream_encode(aligned: DataFrame, enc: Encoding, keep: Sequence[str], cutoff: int | None = 1024, path: str | None = None) -> DataFrame:
    """STM-02: ids, mask and labels of aligned rows on a stream; the vocabulary of ``enc`` is a written table, frozen."""
    return collect_stream(encode_sft(aligned, enc, keep, cutoff), "encoded", path=path)


def stream_pack(df: DataFrame, ids: str, order: str, block: int, chunk: Column, batch_rows: int = 1000, path: str | None = None) -> DataFrame:
    """STM-02: blocks of ``block`` ids from documents on a stream, batch by batch of ``batch_rows`` as in a table.

    Documents of an unfinished batch wait for the next trigger.
    """
    narrow = df.select(order, ids)

    def step(rows: DataFrame) -> DataFrame:
        packed = pack(rows.withColumn("batch", group_of(batch_rows)), [ids], "batch", "_pos", block)
        return packed.select("batch", "block", F.col(ids).alias("input_ids"), attention_mask(F.col(ids)).alias("attention_mask"))

    kinds = "batch long, block long, input_ids array<int>, attention_mask array<int>"
    return in_groups(narrow, [order], chunk, batch_rows, step, T.StructType.fromDDL(kinds), folder(df.sparkSession, path, "packed"))


def stream_interleave(
    df: DataFrame, dataset: str, datasets: int, order: Sequence[str], chunk: Column, probs: Sequence[float] | None = None, seed: int = 42, path: str | None = None
) -> DataFrame:
    """MIX-02 and, with ``probs``, MIX-04 on a stream of several datasets (numbered by ``dataset``), until the first ends.

    The rank of a row in its dataset goes on from trigger to trigger.  Slots go out as far as every dataset has rows for
    them; rows that are ahead wait.  What waits when the stream ends belongs to slots behind the end of a dataset, so the
    result is that of the table.  Repeating short datasets needs their ends and is no stream operation.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, path, "interleave")
    ranks = KeyedCounts(spark, f"{path}/ranks", [df.schema[dataset]])
    used = KeyedCounts(spark, f"{path}/used", [df.schema[dataset]])
    carry = Carry(spark, f"{path}/carry", T.StructType([*df.schema.fields, T.StructField("_rank", T.LongType())]))
    small = lambda rows: {r[dataset]: r["n"] for r in rows.collect()}  # noqa: E731  one row per dataset

    def one(batch: DataFrame, batch_id: int) -> DataFrame:
        before = small(ranks.before(batch_id))
        new = small(ranks.add(batch_id, batch.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))))
        total = [before.get(i, 0) + new.get(i, 0) for i in range(datasets)]
        base = F.create_map(*[F.lit(x).cast("long") for i in range(datasets) for x in (i, before.get(i, 0))])
        placed = positions(batch, [dataset], order, chunk, "_rank")
        every = carry.after(batch_id - 1).unionByName(placed.withColumn("_rank", F.col("_rank") + base[F.col(dataset).cast("long")]))
        if probs is None:
            limit = min(total)
            carry.keep(batch_id, every.where(F.col("_rank") >= limit))
            ready = every.where(F.col("_rank") < limit).withColumn("slot", F.col("_rank") * datasets + F.col(dataset))
            return ready.drop("_rank")
        past = small(used.before(batch_id))
        done = [past.get(i, 0) for i in range(datasets)]
        slots = drawn_slots(spark, sum(done), sum(total) - sum(done), probs, seed)
        start = F.create_map(*[F.lit(x).cast("long") for i in range(datasets) for x in (i, done[i])])
        slots = positions(slots, ["source"], ["slot"], id_chunk("slot"), "_at")
        slots = slots.select("slot", F.col("source").alias(dataset), (F.col("_at") + start[F.col("source").cast("long")]).alias("_rank"))
        ends = F.create_map(*[F.lit(x).cast("long") for i in range(datasets) for x in (i, total[i])])
        # as in a table, the slot that takes a dataset's last row is the last one, until that dataset goes on
        taken = F.col("_rank") == ends[F.col(dataset).cast("long")] - 1
        stop = slots.agg(F.min(F.when(taken, F.col("slot")))).first()[0] if all(t > d for t, d in zip(total, done, strict=True)) else -1
        slots = slots.where(F.col("slot") <= stop)
        used.add(batch_id, slots.groupBy(dataset).agg(F.count(F.lit(1)).alias("n")))
        ready = every.join(slots, [dataset, "_rank"])
        carry.keep(batch_id, every.join(slots, [dataset, "_rank"], "left_anti"))
        return ready.select(*df.columns, "slot")

    return run_through(df, one, path, T.StructType([*df.schema.fields, T.StructField("slot", T.LongType())]))


def stream_poll_windows(df: DataFrame, ts: str, value: str, width: str, delay: str) -> DataFrame:
    """STM-07: tumbling peak of a polled value; windows are emitted once the watermark passed them."""
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    peaks = timed.groupBy(F.window("_ts", width)).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("polls"))
    return peaks.select(F.col("window.start").alias("window_start"), "peak", "polls")


def stream_union(dfs: Sequence[DataFrame]) -> DataFrame:
    """STM-08: streams one after another by arrival, not mixed; ``dataset_idx`` tells the source."""
    result = None
    for i, df in enumerate(dfs):
        part = df.withColumn("dataset_idx", F.lit(i))
        result = part if result is None else result.unionByName(part)
    return result
