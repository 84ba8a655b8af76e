"""Prediction by partial matching: a byte-context trie over the corpus, escapes, symbol exclusion, log10 probability of texts.

The trie is kept as a table: one row per context of ORDER bytes with the byte that follows, six bytes in one long.  Texts
stay in blocks; every block asks the table for the distinct windows and tokens that it has, so no task needs the model
whole and nothing is broadcast but the counts of byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import tasks_for, written
from corpusflow.llm.texts import LOWER, SPACED, give_back_memory, slices, span_hashes, strings, word_spans

ORDER = 5
END = 0xFF  # ends a text and stands before it; no byte of UTF-8
# The escape of an order is estimated from how many of its windows were seen once and twice, see :func:`discount`; these are
# its value before any window was seen and the number of windows that this weighs as much as.
PRIOR, PRIOR_WINDOWS = 0.35, 20
BLOCK_BYTES = 50_000_000
# Windows that one task turns into code lengths.
WINDOWS_PER_TASK = 2_000_000
_TOKEN = np.uint64(1 << 63)  # marks token keys, which so are negative longs; the end of a text is this one itself


_NO_KEYS = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def streams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to predict, offsets of each text in them, token keys of the words, number of words before each text.

    A text is its lower-cased words with one space between and END behind; before it stand ORDER times END as context.
    """
    data, offsets = strings(column)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets, SPACED)
    n_words, sizes = np.diff(counts), ends - starts + 1
    before = np.concatenate([[0], np.cumsum(sizes)])
    lengths = np.maximum(before[counts[1:]] - before[counts[:-1]], 1) + ORDER
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(at[-1], END, np.uint8)
    if len(starts):
        owner = np.repeat(np.arange(len(n_words)), n_words)
        target = at[owner] + ORDER + before[:-1] - before[counts[owner]]
        within = np.arange(before[-1]) - np.repeat(before[:-1], sizes)
        source = np.minimum(np.repeat(starts, sizes) + within, len(data) - 1)
        place = np.repeat(target, sizes) + within
        out[place] = data[source]
        last = target + sizes - 1
        out[last] = np.uint8(0x20)
        out[last[counts[1:][n_words > 0] - 1]] = END
    return out, at, span_hashes(data, starts, ends) | _TOKEN, counts


def windows(stream: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every predicted byte with the ORDER bytes before it as one number, and the offsets of each text among them."""
    size = len(stream) - ORDER
    codes = np.zeros(max(size, 0), np.uint64)
    for j in range(ORDER + 1):
        codes <<= np.uint64(8)
        codes |= stream[j : j + size]
    real = np.ones(len(codes), bool)
    for j in range(ORDER):
        real[at[1:-1] - ORDER + j] = False  # windows that reach into the next text's padding
    return codes[real], at - ORDER * np.arange(len(at))


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def added_counts(keys: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``keys`` and ``counts`` (changed in place) with the sorted keys ``new`` counted in; little memory beside them."""
    if not len(keys):
        return new, n.copy()
    at = np.searchsorted(keys, new)
    known = keys[np.minimum(at, len(keys) - 1)] == new
    counts[at[known]] += n[known]
    return np.insert(keys, at[~known], new[~known]), np.insert(counts, at[~known], n[~known])


def counted(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands in training texts."""
    known, n = np.unique(keys[trains], return_counts=True)
    other = np.unique(keys[~trains])
    return merged_counts([(known, n), (other, np.zeros(len(other), np.int64))])


def discount(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """What each seen byte's count gives to bytes not seen yet: with many windows n1 / (n1 + 2 n2), of those seen once and twice."""
    return (once + PRIOR * PRIOR_WINDOWS) / (once + 2 * twice + PRIOR_WINDOWS)


def code_lengths(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each window after the bytes before it.

    ``counts``: training counts of the windows, with all windows that end in the same two context bytes present;
    ``pairs``: of every byte pair, how many bytes stand before it.  A byte counts in a context of the longest order as often
    as it follows it, and in a shorter one once for every longer context (update exclusion).  At each order every byte that the context has seen gives a part of its
    count to the escape, which is estimated for the order from all its contexts that end in the same two bytes (below
    order 2, from all its contexts); bytes that a longer context has seen are excluded from counts and escape of the shorter
    one.  Below order 0, the bytes never seen are equally likely.
    """
    kept = codes[counts > 0]
    order = np.argsort(kept)
    level = {ORDER: (kept[order], counts[counts > 0][order])}
    for d in range(ORDER - 1, 1, -1):
        level[d] = np.unique(level[d + 1][0] & mask(d + 1), return_counts=True)
    single = (pairs > 0).sum(0)

    def count_of(d: int, windows_d: np.ndarray) -> np.ndarray:
        """Count of windows of d + 1 bytes."""
        if d == 0:
            return single[windows_d.astype(np.int64)]
        if d == 1:
            return pairs[(windows_d >> np.uint64(8)).astype(np.int64), (windows_d & np.uint64(255)).astype(np.int64)]
        known, n = level[d]
        if not len(known):
            return np.zeros(len(windows_d), np.int64)
        i = np.minimum(np.searchsorted(known, windows_d), len(known) - 1)
        return np.where(known[i] == windows_d, n[i], 0)

    def context(d: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, number of seen bytes, and how often the order below saw these bytes; zeros for unknown contexts."""
        if d == 0:
            total, seen, below = single.sum()[None], (single > 0).sum()[None], np.zeros(1, np.int64)
            i, known = np.zeros(len(contexts), np.int64), np.full(len(contexts), single.sum() > 0)
        elif d == 1:
            total, seen, below = pairs.sum(1), (pairs > 0).sum(1), ((pairs > 0) * single).sum(1)
            i = contexts.astype(np.int64)
            known = total[i] > 0
        else:
            codes_d, n = level[d]
            if not len(codes_d):
                return (np.zeros(len(contexts), np.int64),) * 3
            names, first = np.unique(codes_d >> np.uint64(8), return_index=True)
            total, seen = np.add.reduceat(n, first), np.diff(np.append(first, len(codes_d)))
            below = np.add.reduceat(count_of(d - 1, codes_d & mask(d)), first)
            i = np.minimum(np.searchsorted(names, contexts), len(names) - 1)
            known = names[i] == contexts
        return tuple(np.where(known, x[i], 0) for x in (total, seen, below))

    def given(d: int, contexts: np.ndarray) -> np.ndarray:
        """The discount of the order in these contexts."""
        if d < 2:
            seen = pairs if d else single
            return np.full(len(contexts), discount((seen == 1).sum(), (seen == 2).sum()))
        codes_d, n = level[d]
        ends = (codes_d >> np.uint64(8) & mask(2)).astype(np.int64)
        each = discount(np.bincount(ends[n == 1], minlength=65_536), np.bincount(ends[n == 2], minlength=65_536))
        return each[(contexts & mask(2)).astype(np.int64)]

    out = np.zeros(len(codes))
    open_, no_total, no_seen = np.ones(len(codes), bool), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for d in range(ORDER, -1, -1):
        total, seen, below = context(d, codes >> np.uint64(8) & mask(d))
        here = count_of(d, codes & mask(d + 1))
        mass, escape, part = total - no_total, seen - no_seen, given(d, codes >> np.uint64(8))
        hit = open_ & (here > 0)
        miss = open_ & (here == 0) & (escape > 0)
        out[hit] += np.log10((here[hit] - part[hit]) / mass[hit])
        out[miss] += np.log10(part[miss] * escape[miss] / mass[miss])
        open_ &= ~hit
        no_total, no_seen = below, seen
    return out - open_ * np.log10(256 - (single > 0).sum() if (single > 0).sum() < 256 else 1)


def blocks(docs: DataFrame, held_out: Column, block_bytes: int) -> DataFrame:
    """Texts by block, and per block its distinct windows and tokens with their training counts, in one written table."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    rows = rows.coalesce(max(1, -(-size // block_bytes)))
    names = ["block", "key", "n", "doc_id", "held_out", "body"]

    def keys_of(block: int, keys: np.ndarray, counts: np.ndarray, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), 100_000):
            part = keys[a : a + 100_000].view(np.int64)
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block, np.int64)), pa.array(part), pa.array(counts[a : a + n]), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())],
                names,
            )

    def per_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, pending, size = TaskContext.get().partitionId() << 32, [], 0, 0
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        id_type = None
        for batch in slices(batches):
            id_type = batch.column("doc_id").type
            stream, at, tokens, words = streams(batch.column("text"))
            codes, code_at = windows(stream, at)
            trains = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            parts.append(counted(codes, np.repeat(trains, np.diff(code_at))))
            parts.append(counted(tokens, np.repeat(trains, np.diff(words))))
            parts.append((np.array([_TOKEN]), np.array([trains.sum()])))
            pending += sum(len(p[0]) for p in parts[-3:])
            size += len(stream)
            if pending > 800_000:
                keys, counts = added_counts(keys, counts, *merged_counts(parts))
                parts, pending = [], 0
            raw = stream.tobytes()
            bodies = [pa.compress(raw[a:b], "zstd", asbytes=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = batch.num_rows
            sizes = pa.array(np.diff(at), pa.int64())
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block, np.int64)), none, sizes, batch.column("doc_id"), batch.column("held_out"), pa.array(bodies, pa.binary())],
                names,
            )
            if size > 1.2 * block_bytes:  # a split may hold any number of bytes
                yield from keys_of(block, *added_counts(keys, counts, *merged_counts(parts or [_NO_KEYS])), id_type)
                block, parts, pending, size = block + 1, [], 0, 0
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if size:
            yield from keys_of(block, *added_counts(keys, counts, *merged_counts(parts or [_NO_KEYS])), id_type)
        del keys, counts, parts
        give_back_memory()

    kinds = [T.LongType(), T.LongType(), T.LongType(), docs.schema["doc_id"].dataType, T.BooleanType(), T.BinaryType()]
    return written(rows.mapInArrow(per_block, T.StructType([T.StructField(*x) for x in zip(names, kinds, strict=True)])), "blocks")


def window_values(totals: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of every window of ``totals`` (key, n)."""
    wins = totals.where("key >= 0")
    pairs = np.zeros((256, 256), np.int64)
    threes = wins.where("n > 0").select(F.col("key").bitwiseAND(0xFFFFFF).alias("three")).distinct()
    for r in threes.groupBy(F.col("three").bitwiseAND(0xFFFF).alias("pair")).agg(F.count(F.lit(1)).alias("n")).collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]  # at most 65,536 rows

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = table["key"].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(code_lengths(keys.astype(np.uint64), table["n"].to_numpy(), pairs))], ["key", "value"]
        )

    # all windows of a context of two bytes or more stand in one task
    shard = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    return wins.repartition(tasks_for(wins, WINDOWS_PER_TASK, 12), shard).mapInArrow(values, "key long, value double")


def scores(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) per row of ``docs`` (doc_id, text, ...).

    The model learns from the rows where ``held_out`` is not true.  ``score`` is the log10 probability of the text's
    lower-cased words with single spaces and an end; ``base_score`` that of its tokens (words and the end) under smoothed
    token counts.  Null, empty and blank texts are the end alone.  Repeated rows count each; other columns are ignored.
    Token counts go by 63-bit hashes of the tokens.
    """
    rows = blocks(docs, held_out, block_bytes)
    asked = rows.where("key IS NOT NULL").select("block", "key", "n")
    totals = written(asked.groupBy("key").agg(F.sum("n").alias("n")), "totals")
    tokens = totals.where("key < 0")
    seen = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    mass = seen["n"] + 0.5 * (seen["v"] + 1)
    base = tokens.select("key", F.log10((F.col("n") + 0.5) / F.lit(mass)).alias("value"))
    values = written(window_values(totals).union(base), "values")
    answers = asked.select(F.col("block").alias("by"), "key").join(values, "key").select("by", "key", "value")
    texts = rows.where("key IS NULL").select("block", "doc_id", "held_out", F.col("n").alias("size"), "body")
    train_tokens, known_from = int(seen["n"]), float(np.log10(1 / mass))  # a count of one or more lies above this value
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_bytes", T.LongType()),
        ]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        index = pd.Index(right["key"].to_numpy())
        value = right["value"].to_numpy()
        out = []
        end = value[index.get_indexer(np.array([_TOKEN]).view(np.int64))[0]]
        for batch in left.to_batches(max_chunksize=512):
            sizes = batch.column("size").to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            raw = b"".join(pa.decompress(b, n, "zstd", asbytes=True) for b, n in zip(batch.column("body").to_pylist(), sizes.tolist(), strict=True))
            total, known, n_tokens, base_sum = [], [], [], []
            stream = np.frombuffer(raw, np.uint8)
            a = 0
            while a < len(sizes):  # pieces of about 1 MB
                b = max(a + 1, int(np.searchsorted(at, at[a] + 1_000_000, "right")) - 1)
                part, part_at = stream[at[a] : at[b]], at[a : b + 1] - at[a]
                codes, code_at = windows(part, part_at)
                total.append(np.add.reduceat(value[index.get_indexer(codes.view(np.int64))], code_at[:-1]))
                starts, ends, counts = word_spans(part, part_at, _INSIDE)
                token = value[index.get_indexer((span_hashes(part, starts, ends) | _TOKEN).view(np.int64))]
                sums = np.concatenate([[0.0], np.cumsum(token)])
                knowns = np.concatenate([[0], np.cumsum(token > known_from)])
                base_sum.append(sums[counts[1:]] - sums[counts[:-1]] + end)
                known.append(knowns[counts[1:]] - knowns[counts[:-1]] + (end > known_from))
                n_tokens.append(np.diff(counts) + 1)
                a = b
            whole = [np.concatenate(x) for x in (n_tokens, known, base_sum, total)]
            columns = [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(whole[0], pa.int64()),
                pa.array(whole[1], pa.int64()),
                pa.array(np.full(len(sizes), train_tokens), pa.int64()),
                pa.array(whole[2], pa.float64()),
                pa.array(whole[3], pa.float64()),
                pa.array(sizes - ORDER, pa.int64()),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, schema.names))
        kinds = [*[(n, c.type) for n, c in zip(schema.names, columns, strict=True)]] if out else []
        del index, value
        give_back_memory()
        return pa.Table.from_batches(out, pa.schema(kinds)) if out else pa.table({})

    return texts.groupBy("block").cogroup(answers.groupBy("by")).applyInArrow(score, schema)


_INSIDE = SPACED.copy()
_INSIDE[END] = False
