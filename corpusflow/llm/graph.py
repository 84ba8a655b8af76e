"""Classes of linked rows: candidate pairs from key lists without all pairs of a list, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import written

# (row, other rows) -> those of the other rows that it is linked with
Matcher = Callable[[int, np.ndarray], np.ndarray]
# (rows, rows) -> which of these pairs may be linked, and (row, row) -> whether this one is
Pairs = tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[int, int], bool]]
# Blocks of at most so many rows are taken together, until they have so many rows.
SMALL, TOGETHER = 64, 4_096


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every end of ``links`` (a, b); label is the smallest id reachable.

    Each round takes the smallest label among neighbours, then follows labels once (pointer jumping), so that chains
    halve.  Labels live in the shared folder between rounds; nothing comes to the driver but the number of changes.
    Null ends are not linked.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    edges = written(
        links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    least = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    labels = written(least.select("id", F.least("id", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        moved = written(
            step.join(far, "label", "left").select("id", F.least("label", F.coalesce("jump", "label")).alias("label"), "was"),
            "labels",
        )
        changed = moved.where("label <> was").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels


def linked(
    lists: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    apart: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Components (id, label) of all verified links between members of one list.

    ``lists``: (key, id, indexed), distinct, cheap to read; two members of a key are a candidate if either is indexed.
    ``verify``: pairs (a, b) -> those that are links.  ``apart``: rows (key, id, indexed, label) of lists whose members
    have several labels -> links (a, b) between labels, enough of them to join all labels that have linked members.

    First every member meets the smallest indexed member of its list: one pair per row.  After that, only members that
    are not yet in one component can change the result, and ``apart`` sees the lists that still have several.  So a group
    of n copies costs n pairs and no link that matters is lost.
    """
    hubs = lists.groupBy("key").agg(
        F.min(F.when(F.col("indexed"), F.col("id"))).alias("hub"), F.count(F.lit(1)).alias("size")
    )
    met = written(lists.join(hubs.where("hub IS NOT NULL AND size > 1"), "key"), "met")
    stars = met.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = written(verify(stars), "links")
    labels = components(links)
    named = met.where("size > 2").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # the pairs with the hub are done; a list whose other members have one label is, too
    named = named.where("id <> hub").select("key", "id", "indexed", "label")
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rest = written(named.join(several.select("key"), "key"), "rest")
    more = written(apart(rest), "more")
    if more.limit(1).count() == 0:
        return labels
    return components(links.union(more))


def dealt(rows: DataFrame, group: str, block: int, *more: str) -> DataFrame:
    """Rows of a group in blocks of about ``block``, each row once for every pair (i, j) of blocks that has its own."""
    blocks = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    own = F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")
    every = rows.join(blocks, group).withColumn("own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    every = every.withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o"))
    return every.select(F.col(group).alias("grp"), "i", "j", "own", "id", "label", *more)


def forest(rows: DataFrame, matcher: Callable[[pa.Table], Matcher], *kin: str, few: Callable[[pa.Table], Pairs] | None = None) -> DataFrame:
    """Links (a, b) between labels that join all labels with linked members in one pair of blocks.

    ``rows``: (grp, i, j, own, id, label, payload, ...); ``matcher`` prepares the rows of a pair of blocks.  A task holds
    one pair of blocks.  Only members outside its commonest label are looked up, since a pair of different labels has such
    an end, and only against labels that are not joined yet.  At most one link per label leaves the task.
    Blocks that are equal in the columns ``kin`` and in i and j come to one task, one after the other.  With ``few`` the
    pairs of many small blocks are looked at together; then labels that one of them joins are joined for the others.
    """
    columns = ["grp", "i", "j"]
    rows = rows.repartition(*(kin or ["grp"]), "i", "j").sortWithinPartitions(*kin, *columns)
    kind = rows.schema["label"].dataType

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        within = table["i"][0].as_py() == table["j"][0].as_py()
        own, names = table["own"].to_numpy(), table["label"].combine_chunks()
        firsts, labels = np.unique(names.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)[1:]
        match, root = matcher(table), np.arange(len(firsts))
        joined: list[tuple[int, int]] = []
        commonest = np.bincount(labels).argmax()
        for x in np.flatnonzero(labels != commonest).tolist():
            apart = root[labels] != root[labels[x]]
            others = np.flatnonzero(apart if within else apart & (own != own[x]))
            if not len(others):
                continue
            for y in np.unique(labels[match(x, others)]).tolist():
                if root[y] != root[labels[x]]:
                    joined.append((labels[x], y))
                    root[root == root[y]] = root[labels[x]]
        ends = [pa.array([firsts[pair[e]] for pair in joined], pa.int64()) for e in (0, 1)]
        return pa.RecordBatch.from_arrays([names.take(e) for e in ends], ["a", "b"])

    def together(held: list[pa.RecordBatch], sizes: list[int]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        names, every = table["label"].combine_chunks(), np.array(sizes)
        labels = names.dictionary_encode().indices.to_numpy()
        after = np.concatenate([np.arange(n - 1, -1, -1) for n in sizes])  # rows of its block that come after a row
        x = np.repeat(np.arange(every.sum()), after)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
        i, j, own = (table[c].to_numpy() for c in ("i", "j", "own"))
        apart = (labels[x] != labels[y]) & ((i == j)[x] | (own[x] != own[y]))
        x, y = x[apart], y[apart]
        possible, near = few(table)
        able = possible(x, y)
        root = list(range(len(table)))
        joined: list[tuple[int, int]] = []

        def find(label: int) -> int:
            while root[label] != label:
                root[label] = label = root[root[label]]
            return label

        for a, b in zip(x[able].tolist(), y[able].tolist(), strict=True):
            p, q = find(labels[a]), find(labels[b])
            if p != q and near(a, b):
                root[p] = q
                joined.append((a, b))
        ends = [pa.array([pair[e] for pair in joined], pa.int64()) for e in (0, 1)]
        return pa.RecordBatch.from_arrays([names.take(e) for e in ends], ["a", "b"])

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[pa.RecordBatch] = []
        sizes: list[int] = []
        rows_held = 0
        for held in blocks(batches):
            n = sum(b.num_rows for b in held)
            if few is None or n > SMALL:
                yield block(held)
                continue
            small += held
            sizes.append(n)
            rows_held += n
            if rows_held >= TOGETHER:
                yield together(small, sizes)
                small, sizes, rows_held = [], [], 0
        if small:
            yield together(small, sizes)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in columns], strict=True))
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                if held and keys[start] != at:
                    yield held
                    held = []
                at = keys[start]
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield held

    return rows.mapInArrow(whole, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
