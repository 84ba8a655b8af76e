"""Near-duplicate documents by bottom-k sketches: inverted lists, union-sketch filter, exact Jaccard, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.graph import Matcher, components, dealt, forest, linked
from corpusflow.llm.tables import broadcast_if_small, only_keys, written
from corpusflow.llm.texts import LOWER, SPACED, lists, shingle_sets, slices, span_hashes, strings, word_spans

SKETCH = 96
# Accepted chance that two documents at exactly the least similarity are not compared.
MISS = 1e-8
# Members that one task compares with a copy of their hub; larger groups are dealt over several copies.
PER_HUB = 512
# Members that one task compares, by their sketches and by their full sets; more are dealt over pairs of such blocks.
SKETCH_BLOCK = 4_096
TEXT_BLOCK = 512


def least_overlap(k: int, percent: int, miss: float = MISS) -> int:
    """Largest t such that fewer than t of the k smallest union values being shared has a chance below ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below >= miss:
            return t
    return k


def batch_sets(batch: pa.RecordBatch, shingle: int, column: str = "text") -> list[np.ndarray]:
    data, offsets = strings(batch.column(column))
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets, SPACED)
    return list(shingle_sets(span_hashes(data, starts, ends), counts, shingle))


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """Per row of (doc_id, text): number of distinct shingles, a digest of the set and its k smallest hashes."""

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = batch_sets(batch, shingle)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    lists([s[:k] for s in sets], pa.int64()),
                ],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(per_batch, schema)


def inverted_lists(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, id, indexed) of retained values, from (id, n_shingles, sketch).

    Two linked sets share at least t retained values.  With each sketch in one order, rarest value first, they then
    share one of the first size - t + 1: only those are listed, so values that very many sketches hold list hardly
    anybody.  Sets with fewer than t values that anyone shares have no partner at all.
    """
    need = F.least(F.ceil(F.size("sketch") * F.lit(percent) / 100), F.lit(least_overlap(k, percent))).cast("int")
    values = sets.select("id", need.alias("need"), F.explode("sketch").alias("key"))
    shared = values.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    ranked = (
        values.join(shared, "key")
        .groupBy("id", "need")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "key"))).alias("kept"))  # at most k
        .where("size(kept) >= need")
    )
    rare = F.expr("slice(kept, 1, size(kept) - need + 1)")
    return ranked.select("id", F.explode(rare).alias("e")).select("e.key", "id", F.lit(True).alias("indexed"))


def similar_sketches(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch shares as many values as a linked pair's does (but for a chance below MISS)."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("sketch").alias(f"_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = both.withColumn("_u", F.slice(F.array_sort(F.array_union("_a", "_b")), 1, k))
    shared = F.size(F.array_intersect(F.array_intersect("_a", "_b"), "_u"))
    need = F.least(F.ceil(F.size("_u") * F.lit(percent) / 100), F.lit(least_overlap(k, percent)))
    return union.where(shared >= need).select("a", "b")


def apart_links(rest: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """Links between labels of members (key, id, label) that the first round left in different components.

    Labels whose sketches allow a link make a group; inside the groups the full sets are compared.
    """
    most = least_overlap(k, percent)

    def sharing(sets: list[np.ndarray], fits: Callable[..., np.ndarray]) -> Matcher:
        """How much each set shares with all others comes from an inverted list of their values."""
        lengths = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        values, holders = flat[order], np.repeat(np.arange(len(sets)), lengths)[order]

        def match(x: int, others: np.ndarray) -> np.ndarray:
            lo, hi = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
            shared = np.bincount(np.concatenate([holders[p:q] for p, q in zip(lo, hi, strict=True)]), minlength=len(sets))
            return others[fits(shared[others], lengths[x], lengths[others])]

        return match

    def possible(shared: np.ndarray, own: int, sizes: np.ndarray) -> np.ndarray:
        return shared >= np.minimum(most, np.ceil(np.maximum(own, sizes) * percent / 100))

    def similar(shared: np.ndarray, own: int, sizes: np.ndarray) -> np.ndarray:
        return (shared > 0) & (100 * shared >= percent * (own + sizes - shared))

    def by_sketches(table: pa.Table) -> Matcher:
        column = table["payload"].combine_chunks()
        cuts = (column.offsets.to_numpy() - column.offsets[0].as_py())[1:-1]
        return sharing(np.split(column.flatten().to_numpy(), cuts), possible)

    def by_texts(table: pa.Table) -> Matcher:
        pieces = [piece for batch in table.to_batches() for piece in slices([batch], "payload")]
        return sharing([s for piece in pieces for s in batch_sets(piece, shingle, "payload")], similar)

    sketched = dealt(rest, "key", SKETCH_BLOCK).join(sets.select("id", F.col("sketch").alias("payload")), "id")
    maybe = written(forest(sketched, by_sketches), "maybe")
    groups = components(maybe).select(F.col("id").alias("label"), F.col("label").alias("family"))
    members = written(rest.select("id", "label").distinct().join(groups, "label"), "members")
    ends = only_keys(texts, members.select("id").distinct(), "id").dropDuplicates(["id"])
    full = dealt(members, "family", TEXT_BLOCK).join(ends.select("id", F.col("text").alias("payload")), "id")
    return forest(full, by_texts)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough, by their texts (id, text).

    The rows of one a are dealt over tasks with a copy of a's text each, ``PER_HUB`` at a time, and stream through the
    task: it holds one hub's set and one batch.
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).cast("long").alias("copies"))
    copies = written(copies, "copies")
    hubs = copies.join(texts, copies.a == texts.id).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("part"), F.col("a").alias("b"), "text"
    )
    members = pairs.join(broadcast_if_small(copies), "a").join(texts, pairs.b == texts.id)
    members = members.select("a", F.pmod(F.xxhash64("b"), "copies").alias("part"), "b", "text")
    rows = hubs.select("*", F.lit(0).alias("member")).union(members.select("*", F.lit(1).alias("member")))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.int64)
        for batch in slices(batches):
            found = []
            for i, (values, member) in enumerate(zip(batch_sets(batch, shingle), batch.column("member").to_pylist(), strict=True)):
                if not member:
                    hub = values
                    continue
                common = len(np.intersect1d(hub, values, assume_unique=True))
                if common and 100 * common >= percent * (len(hub) + len(values) - common):
                    found.append(i)
            yield batch.select(["a", "b"]).take(pa.array(found, pa.int64()))

    return rows.mapInArrow(compare, pairs.select("a", "b").schema)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text, ...).

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of word shingles; component_id is the
    smallest doc_id reachable over links.  Equal sets are one node of the graph, so exact copies cost nothing more.
    Null and empty texts and texts of white space have no shingles and are linked with nothing.  A row without doc_id is
    linked with nothing: component_id is null and kept is true.  Repeated rows share their doc_id and so their result;
    a doc_id is expected to have one text.  Other columns are ignored.
    """
    found = written(sketches(docs, shingle, k), "sketches")
    sets = written(
        found.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sketch").alias("sketch")),
        "sets",
    )
    candidates = written(inverted_lists(sets, k, percent), "lists")

    texts = docs.select(F.col("doc_id").alias("id"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(similar_sketches(pairs, sets, k, percent), "similar")
        ends = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ends")
        return confirmed(pairs, only_keys(texts, ends, "id").dropDuplicates(["id"]), shingle, percent)

    def apart(rest: DataFrame) -> DataFrame:
        return apart_links(rest, sets, texts, shingle, k, percent)

    labels = linked(candidates, verify, apart)
    named = sets.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("_class"))
    own = F.when(F.col("n_shingles") > 0, F.col("_class")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return (
        found.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
