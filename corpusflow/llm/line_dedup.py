"""Repeated lines by a segment-partition edit join: equal segments of lines propose, furthest places on few diagonals decide.

Lines may differ by more edits the longer they are, see :func:`edits_of`.  Lengths fall into classes of one number of edits t;
the lines of a class have t + 1 segments of one size, the first half counted from the start of the line, the rest from its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.graph import Matcher, Pairs, dealt, forest, linked
from corpusflow.llm.tables import BROADCAST_KEYS, broadcast_if_small, written
from corpusflow.llm.texts import mixed, powers, slices

EDITS = 2
MIN_CHARS = 20
# Of longer lines: an edit for so many characters, but no more than the root of length / ROOT.  The keys of a line grow with
# the square of its edits, so by the root they grow with its length.
PER_EDIT = 48
ROOT = 7
SPREAD = 8
# A key that has more than one of so many rows of all frequent keys is dealt over SALTS parts; so there are at most so many.
HOT = 1_000
SALTS = 64
# Texts of one in so many are looked at to find those keys, and fewer rows than LEAST there are never many.
SAMPLE = 64
LEAST = 256
# Lines that a task remembers to have made keys of.
REMEMBERED = 200_000
# Keys made at once.
_PIECE = 200_000
# Lines that one task compares; more lines of one key are dealt over pairs of such blocks.
BLOCK = 4_096
# Counts of the characters of a line, by code point modulo so many, that rule pairs out before their distance is computed.
KINDS = 64
# Lists with one smallest label, of about so many rows in all, go to one task, which remembers so many pairs it compared.
KIN = 16_384
PAIRS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Powers that are kept, and hashes of the commonest code points.
_POWERS = 1 << 20
_KNOWN: dict[int, np.ndarray] = {}
_MIXED = mixed(np.arange(1, 1025, dtype=np.uint64))
# Code points weighed at once, so that the arrays stay in the processor's cache, and the segments of classes, made once.
_CACHED = 1 << 15
_SEGMENTS: dict[tuple[int, int], tuple] = {}
# Text whose keys go to one task, about, parts that a task gets of them, and keys that a task deals out together.
KEY_BYTES = 8_000_000
PARTS = 8
_DEALT = 1_000_000
# A place of a line; ``row`` tells texts that share a doc_id, or have none, apart.
PLACE = ["doc_id", "line", "row"]


def edits_of(length: int, edits: int) -> int:
    """Edits by which a line of this length may differ from a longer one."""
    return max(edits, min(length // PER_EDIT, isqrt(length // ROOT)))


def shortest(edits: int) -> int:
    """The least length that allows so many edits."""
    return max(PER_EDIT * edits, ROOT * edits * edits)


def linked_lines(a: str, b: str, edits: int) -> bool:
    return distance_within(a, b, edits_of(min(len(a), len(b)), edits))


def text_digest() -> Column:
    return F.xxhash64("text")


def common(a: str, b: str, i: int, j: int) -> int:
    """Length of the common start of a from i on and b from j on, by growing and then by halving pieces."""
    start, end = j, min(len(b), len(a) - i + j)
    size = 8
    while j < end and a[i : i + size] == b[j : j + size]:
        i, j, size = i + size, j + size, 2 * size
    while size > 1 and j < end:
        size //= 2
        if a[i : i + size] == b[j : j + size]:
            i, j = i + size, j + size
    return min(j, end) - start


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance in characters is at most ``most``.

    For every number of edits, the furthest place on each diagonal that they can reach; between edits the common characters
    are passed in few comparisons.  Only diagonals are kept from which the edits left lead back to the last cell's.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    last = n - m
    if last > most:
        return False
    # places in b by diagonal, from -most - 1 on; the place in a is further by the diagonal
    none, middle = -2, most + 1
    reached = [none] * (2 * most + 3)
    reached[middle] = j = common(a, b, 0, 0)
    if last == 0 and j == m:
        return True
    for edits in range(1, most + 1):
        left = most - edits
        further = [none] * (2 * most + 3)
        for k in range(max(-edits, last - left), min(edits, last + left) + 1):
            at = middle + k
            j, other = reached[at] + 1, reached[at + 1] + 1
            if other > j:
                j = other
            other = reached[at - 1]
            if other > j:
                j = other
            if j < 0 or j + k < 0:
                continue
            if j >= m or j + k >= n:
                j = min(m, n - k)
            elif a[j + k] == b[j]:
                j += common(a, b, j + k, j)
            if k == last and j == m:
                return True
            further[at] = j
        reached = further
    return False


class Bags:
    """Lengths and character counts of lines.  An edit adds at most one character to a line and takes at most one from it."""

    def __init__(self, texts: list[str], edits: int, line: list[int] | None = None) -> None:
        """``line``: numbers of the texts that the lines are, if not each text is one."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        kinds = np.repeat(np.arange(len(texts)), self.lengths) * KINDS + points % KINDS
        self.counts = np.bincount(kinds, minlength=KINDS * len(texts)).reshape(-1, KINDS).astype(np.int32)
        if line is not None:
            self.lengths, self.counts = self.lengths[line], self.counts[line]
        self.edits = edits

    def possible(self, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        """Whether the lines x and y can be within the edits of the shorter: never false if they are."""
        shorter = np.minimum(self.lengths[x], self.lengths[y])
        most = np.maximum(self.edits, np.minimum(shorter // PER_EDIT, np.sqrt(shorter // ROOT).astype(np.int64)))
        out = np.abs(self.lengths[x] - self.lengths[y]) <= most
        near = np.flatnonzero(out)
        for a in range(0, len(near), BLOCK):
            at = near[a : a + BLOCK]
            more = self.counts[y[at]] - (self.counts[x] if np.ndim(x) == 0 else self.counts[x[at]])
            added = np.maximum(more, 0).sum(1)
            out[at] = np.maximum(added, added - more.sum(1)) <= most[at]
        return out


def classes(longest: int, edits: int) -> list[tuple[int, int, int]]:
    """(least length, greatest length, edits) of all classes up to a length.

    Where the base number of edits holds, a class spans an eighth of its least length, so that segments stay long; its
    neighbours' lines within reach probe both.  Beyond, a class is all lengths with one number.
    """
    out, low = [], 0
    while low <= longest:
        t = edits_of(low, edits)
        high = shortest(t + 1) - 1
        if t == edits:
            high = min(high, low + max(t + 1, low // SPREAD) - 1)
        out.append((low, high, t))
        low = high + 1
    return out


def known_powers(n: int, step: np.uint64) -> np.ndarray:
    """The first powers of a number; those that most batches need are made once."""
    if n > _POWERS:
        return powers(n, step)
    if int(step) not in _KNOWN:
        _KNOWN[int(step)] = powers(_POWERS, step)
    return _KNOWN[int(step)][:n]


class HashedLines:
    """The lines of a batch of texts as code points, with hashes of any of their substrings."""

    def __init__(self, texts: list[str | None]) -> None:
        whole = "\n".join([t or "" for t in texts])
        points = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        breaks = np.flatnonzero(points == 10)
        self.starts = np.concatenate([[0], breaks + 1])
        self.lengths = np.append(breaks, len(points)) - self.starts
        steps = known_powers(len(points), _STEP)
        self.sums = np.empty(len(points) + 1, np.uint64)
        self.sums[0] = 0
        for a in range(0, len(points), _CACHED):
            part = points[a : a + _CACHED]
            if part.dtype == np.uint8:
                weighted = _MIXED[part]
            else:
                weighted = _MIXED[np.minimum(part, len(_MIXED) - 1)]
                rare = np.flatnonzero(part >= len(_MIXED))
                weighted[rare] = mixed(part[rare].astype(np.uint64) + np.uint64(1))
            weighted *= steps[a : a + _CACHED]
            weighted[:1] += self.sums[a]
            np.cumsum(weighted, out=self.sums[a + 1 : a + 1 + len(part)])
        self.back = known_powers(len(points) + 1, _BACK)
        self.per_text = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)

    def hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.back[start] + size.astype(np.uint64))

    def ids(self, lines: np.ndarray) -> np.ndarray:
        return (self.hashes(self.starts[lines], self.lengths[lines]) >> np.uint64(2)).astype(np.int64)


def keys_of(lines: HashedLines, chosen: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, 2 * id + indexed) of the chosen lines: their own segments, and the substrings that probe others' segments.

    If two lines differ by at most the edits t of the shorter one, one of its t + 1 segments stands unchanged in the longer.
    """
    if not len(chosen):
        return
    length, ids = lines.lengths[chosen], lines.ids(chosen)
    every = classes(int(length.max()), edits)
    at = np.searchsorted([low for low, _, _ in every], length, "right") - 1
    for c in np.unique(at).tolist():
        part = at == c
        part, own = chosen[part], ids[part]
        yield from keys_by_class(lines, part, own, *every[c])
        below = c - 1
        while below >= 0 and every[below][1] + every[below][2] >= every[c][0]:  # a shorter line of it is within reach
            near = lines.lengths[part] <= every[below][1] + every[below][2]
            yield from keys_by_class(lines, part[near], own[near], *every[below])
            below -= 1


def segments(low: int, t: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of the class from length ``low`` on: the size of segments and, for each key of a line, its place, whether that counts
    from the line's end, what names its segment, 1 if it is unmoved; and whether all lie inside every line of the class or longer.

    Of t + 1 segments one, the i-th from 0, is unchanged with exactly i edits before it and so at most t - i behind it.
    Counted from the start of the line it moves by at most i, counted from the end by at most t - i.
    """
    if (low, t) not in _SEGMENTS:
        size, i = low // (t + 1), np.arange(t + 1)
        reach = np.minimum(i, t - i)
        move = np.concatenate([np.arange(-r, r + 1) for r in reach.tolist()])
        i = np.repeat(i, 2 * reach + 1)
        from_end = i > t - i
        place, name = np.where(from_end, i - t - 1, i) * size + move, mixed((i + (low << 24)).astype(np.uint64))
        within = np.where(from_end, (place + low >= 0) & (place + size <= 0), (place >= 0) & (place + size <= low))
        _SEGMENTS[low, t] = size, place, from_end, name, (move == 0).astype(np.int64), bool(within.all())
    return _SEGMENTS[low, t]


def keys_by_class(lines: HashedLines, chosen: np.ndarray, ids: np.ndarray, low: int, high: int, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of lines, none shorter than the class, in that class: indexed are unmoved segments of the class's own lines."""
    size, place, from_end, name, unmoved, within = segments(low, t)
    step = max(1, _PIECE // len(place))
    for a in range(0, len(chosen), step):
        part = chosen[a : a + step]
        length, first = lines.lengths[part], lines.starts[part]
        end = first + length
        start = np.where(from_end, end[:, None], first[:, None]) + place
        if not within:
            inside = (start >= first[:, None]) & (start + size <= end[:, None])
            start = np.clip(start, 0, len(lines.sums) - 1 - size)
        value = lines.sums[start + size]
        value -= lines.sums[start]
        value *= lines.back[start]
        key = mixed(value + name).view(np.int64)
        row = (2 * ids[a : a + step])[:, None] + (length <= high)[:, None] * unmoved
        yield (key.ravel(), row.ravel()) if within else (key[inside], row[inside])


def key_arrays(batches: Iterable[pa.RecordBatch], edits: int, min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of the lines of all texts; a line that a task remembers gives no keys again."""
    done: set[int] = set()
    for batch in slices(batches):
        lines = HashedLines(batch.column("text").to_pylist())
        chosen = np.flatnonzero(lines.lengths >= min_chars)
        ids, first = np.unique(lines.ids(chosen), return_index=True)
        new = np.fromiter((x not in done for x in ids.tolist()), bool, len(ids))
        if len(done) > REMEMBERED:
            done.clear()
        done.update(ids.tolist())
        yield from keys_of(lines, chosen[first[new]], edits)


def hot_keys(docs: DataFrame, edits: int, min_chars: int) -> list[int]:
    """Keys of very many lines, by a sample of the texts: at most HOT.  They are only spread, never left out."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, row in key_arrays(batches, edits, min_chars):
            for a in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000]), pa.array(row[a : a + 100_000])], ["key", "row"])

    rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(keys, "key long, row long")
    counts = written(rows.distinct().groupBy("key").count().where(F.col("count") >= LEAST), "frequent")
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [r["key"] for r in counts.where(F.col("count") * HOT >= total).select("key").collect()]


def shared_keys(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(key, id, indexed), distinct, of keys that several lines have, at least one of them indexed.

    One shuffle: rows go in arrays to the part of their key, meet there and leave it only if they have company.  Hot keys
    surely have, so their rows are dealt by id over several parts.
    """
    docs, hot = docs.select("text"), np.array(hot_keys(docs, edits, min_chars), np.int64)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(-(-size // KEY_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // 1_000_000)), 1)
    parts = np.uint64(tasks * PARTS)

    def dealt_rows(pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, row = (np.concatenate(x) for x in zip(*pieces, strict=True))
        salt = np.where(np.isin(key, hot), (row >> 1) % SALTS + 1, 0) if len(hot) else np.zeros(1, np.int64)
        part = (mixed(key.view(np.uint64) + salt.astype(np.uint64) * _STEP) % parts).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")  # numbers of 16 bits go by radix
        pairs, part = np.stack([key[order], row[order]], 1), part[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        at = (16 * np.append(first, len(part))).astype(np.int32)
        held = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(pairs)])
        return pa.RecordBatch.from_arrays([pa.array(part[first]), held], ["part", "pairs"])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for key, row in key_arrays(batches, edits, min_chars):
            pieces.append((key, row))
            n += len(key)
            if n >= _DEALT:
                yield dealt_rows(pieces)
                pieces, n = [], 0
        if n:
            yield dealt_rows(pieces)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = b"".join([x for batch in batches for x in batch.column("pairs").to_pylist()])
        key, row = np.frombuffer(raw, np.int64).reshape(-1, 2).T
        # few keys come more than once: others go by their low bits before rows are put in order
        ordered, low = np.sort(key), (1 << max(len(key).bit_length(), 8)) - 1
        several = np.zeros(low + 1, bool)
        several[ordered[1:][ordered[1:] == ordered[:-1]] & low] = True
        company = several[key & low]
        if len(hot):
            company |= np.isin(key, hot)
        key, row = key[company], row[company]
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        # the last row of a line and key says whether it is indexed there
        ends = np.append((key[1:] != key[:-1]) | (row[1:] >> 1 != row[:-1] >> 1), True)[: len(key)]
        key, row = key[ends], row[ends]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        lines = np.diff(np.append(first, len(key)))
        some = np.add.reduceat(row & 1, first) > 0 if len(first) else np.zeros(0, bool)
        kept = np.repeat((lines > 1) & some, lines)
        if len(hot):
            kept |= np.isin(key, hot)
        key, row = key[kept], row[kept]
        for a in range(0, len(key), 100_000):
            k, r = key[a : a + 100_000], row[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r >> 1), pa.array((r & 1).astype(bool))], ["key", "id", "indexed"])

    return docs.mapInArrow(deal, "part int, pairs binary").repartition(int(tasks), "part").mapInArrow(meet, "key long, id long, indexed boolean")


def line_places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line, row, id) of all lines that take part; lines count from 0."""

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = HashedLines(batch.column("text").to_pylist())
            chosen = np.flatnonzero(lines.lengths >= min_chars)
            first = np.cumsum(lines.per_text) - lines.per_text
            owner = np.searchsorted(first, chosen, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(chosen - first[owner]), batch.column("row").take(pa.array(owner)), pa.array(lines.ids(chosen))],
                [*PLACE, "id"],
            )

    longs = [T.StructField(name, T.LongType()) for name in (*PLACE[1:], "id")]
    return docs.select("doc_id", "text", text_digest().alias("row")).mapInArrow(places, T.StructType([docs.schema["doc_id"], *longs]))


def line_classes(docs: DataFrame, by_id: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(id, label) of the lines that have a partner within the edits of the shorter; label is the same all over a component.

    ``by_id``: (id, at), with a place of each line.
    """
    lists = written(shared_keys(docs, edits, min_chars), "lists")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = written(by_id.select("id", "at.*").join(broadcast_if_small(ids, BROADCAST_KEYS), "id", "left_semi"), "wanted")
        source = docs.select(F.col("doc_id").alias("d"), "text", text_digest().alias("r"))
        per_text = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line", "id")).alias("at"))
        found = source.join(broadcast_if_small(per_text), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")))

        def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                    lines = text.split("\n")
                    columns = [pa.array([x["id"] for x in at], pa.int64()), pa.array([lines[x["line"]] for x in at], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "text"])

        return found.select("text", "at").mapInArrow(chosen, "id long, text string").dropDuplicates(["id"])

    held: list[DataFrame] = []  # texts of all lines in lists of several: what is compared later is among them

    def verify(pairs: DataFrame) -> DataFrame:
        ends = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ends")
        texts = written(texts_of(ends), "texts")
        held.append(texts)
        left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))

        def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
                n = np.arange(len(x))
                able = Bags(x + y, edits).possible(n, n + len(x)).tolist()
                keep = [able[i] and linked_lines(x[i], y[i], edits) for i in range(len(x))]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(near, "a long, b long")

    known: dict[tuple[int, int], bool] = {}  # every task starts with none; only spares comparing a pair again

    def compared(table: pa.Table) -> tuple[Bags, np.ndarray, Callable[[int, int], bool]]:
        # a line stands in many lists of a table
        names, first, line = np.unique(table["id"].to_numpy(), return_index=True, return_inverse=True)
        texts, ids, line = table["payload"].take(pa.array(first)).to_pylist(), names.tolist(), line.tolist()

        def near(x: int, y: int) -> bool:
            x, y = line[x], line[y]
            pair = (ids[x], ids[y]) if x < y else (ids[y], ids[x])
            if (is_near := known.get(pair)) is None:
                if len(known) >= PAIRS:
                    known.clear()
                is_near = known[pair] = linked_lines(texts[x], texts[y], edits)
            return is_near

        return Bags(texts, edits, line), np.array(table["indexed"].to_pylist(), bool), near

    def by_distance(table: pa.Table) -> Matcher:
        bags, indexed, near = compared(table)

        def match(x: int, others: np.ndarray) -> np.ndarray:
            able = others if indexed[x] else others[indexed[others]]
            able = able[bags.possible(x, able)]
            return able[np.fromiter((near(x, y) for y in able.tolist()), bool, len(able))]

        return match

    def few(table: pa.Table) -> Pairs:
        bags, indexed, near = compared(table)

        def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = indexed[x] | indexed[y]
            out[out] = bags.possible(x[out], y[out])
            return out

        return possible, near

    def apart(rest: DataFrame) -> DataFrame:
        (texts,) = held
        # lines that are alike meet in many lists, so lists of one family are compared in few tasks
        lists = rest.groupBy("key").agg(F.min("label").alias("least"), F.count(F.lit(1)).alias("n"))
        parts = lists.groupBy("least").agg(F.ceil(F.sum("n") / KIN).alias("parts"))
        kin = F.xxhash64("least", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("kin")
        rows = dealt(rest.join(lists.join(parts, "least").select("key", kin), "key"), "key", BLOCK, "indexed", "kin")
        return forest(rows.join(texts.withColumnRenamed("text", "payload"), "id"), by_distance, "kin", few=few)

    return linked(lists, verify, apart)


def deduplicated(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` as c0, c1, ..., with n_lines, n_long, n_removed and clean: the text without repeated lines.

    Lines (between line feeds) of at least ``min_chars`` characters are linked if their edit distance is at most ``edits``,
    or what :func:`edits_of` gives for the shorter one;
    of each component the line first in the order of (doc_id, line) stays, at one place, all others go; shorter lines
    stay.  Texts without removed lines are unchanged.  Null texts are empty and have no lines; an empty text has one.
    Repeated rows, of one doc_id and text, are one document and lose the same lines; other texts of that doc_id lose only
    their own, and of lines at one place of them one stays.  Rows without doc_id are first of all.
    """
    places = written(line_places(docs, min_chars), "places")
    ends = places.groupBy("id").agg(F.min(F.struct(*PLACE)).alias("at"), F.max(F.struct(*PLACE)).alias("last"))
    by_id = written(ends.select("id", "at", (~F.col("at").eqNullSafe(F.col("last"))).alias("repeats")), "lines")
    labels = written(line_classes(docs, by_id, edits, min_chars), "classes")
    named = by_id.join(broadcast_if_small(labels, BROADCAST_KEYS), "id", "left").where("label IS NOT NULL OR repeats")
    stay = named.groupBy(F.coalesce("label", "id").alias("class")).agg(F.min("at").alias("stays"))
    repeated = named.select("id", F.coalesce("label", "id").alias("class")).join(stay, "class").select("id", "stays")
    gone = places.join(broadcast_if_small(written(repeated, "repeated")), "id").where("NOT (struct(doc_id, line, row) <=> stays)")
    gone = written(gone.select(*PLACE).distinct(), "gone")
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    per_doc = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_list(F.col("line").cast("int")).alias("gone"))
    per_doc = F.broadcast(per_doc) if few else per_doc  # few: at most so many triples of longs

    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = F.col(names[docs.columns.index("doc_id")]), F.col(names[docs.columns.index("text")])
    rows = docs.toDF(*names).join(per_doc, key.eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_row")), "left").drop("_doc", "_row")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return rows.select(
        *names,
        n_lines.cast("long").alias("n_lines"),
        F.size(F.filter(lines, lambda x: F.length(x) >= min_chars)).cast("long").alias("n_long"),
        F.when(F.col("gone").isNull(), 0).otherwise(n_gone).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("clean"),
    )
