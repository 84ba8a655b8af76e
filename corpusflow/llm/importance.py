"""Importance resampling towards a target: hashed n-gram features by overlapped regex scans, log ratios, Gumbel top-k.

Separators collapse to single spaces; a scan with overlapping matches, bounded by look-arounds, gives the byte spans of all
n-grams, which are counted by their CRC.  Features are scanned once and kept as bucket numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.order import bases, in_order, numbered
from corpusflow.llm.tables import annotate, broadcast_if_small, tasks_for, written

# 0-9, a-z and all bytes of non-ASCII characters belong to words, A-Z as a-z; everything else separates.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SPACES = regex.compile(rb"  +")
ROWS_PER_RANGE = 1_000_000


def scanner(n: int) -> regex.Pattern:
    """Matches n words in a row, from any word on if matches may overlap."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def collapsed(text: bytes) -> bytes:
    return _SPACES.sub(b" ", text.translate(_PLAIN)).strip()


def feature_buckets(text: bytes, scanners: list[regex.Pattern], buckets: int) -> np.ndarray:
    """Bucket of every n-gram of a collapsed text, repeats included."""
    spans = (m.span() for scan in scanners for m in scan.finditer(text, overlapped=True))
    return np.fromiter((crc32(text[a:b]) % buckets for a, b in spans), np.int32)


def features(docs: DataFrame, longest: int, buckets: int, text: str = "text") -> DataFrame:
    """Columns of ``docs`` as c0, c1, ... with n_words and buckets: those of all runs of 1 to ``longest`` words."""
    scanners = [scanner(n) for n in range(1, longest + 1)]

    def scan(column: pa.Array) -> list[pa.Array]:
        words, found = [], []
        for raw in column.cast(pa.large_binary()).fill_null(b"").to_pylist():
            plain = collapsed(raw)
            words.append(plain.count(b" ") + 1 if plain else 0)
            found.append(feature_buckets(plain, scanners, buckets))
        at = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return [pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))]

    return annotate(docs, text, scan, {"n_words": T.LongType(), "buckets": T.ArrayType(T.IntegerType())})


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds; every task sends one sum per bucket at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    sums = scanned.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / share)) of each bucket, with one added to each count."""
    buckets, all_have, all_want = len(have), float(have.sum() + len(have)), float(want.sum() + len(want))
    ratio = [(float(t) + 1) * all_have / ((float(s) + 1) * all_want) for s, t in zip(have.tolist(), want.tolist(), strict=True)]
    return np.fromiter((floor(1000 * log(r)) for r in ratio), np.int64, buckets)


def noise(seed: int, doc_id: object) -> int:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def importance(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10,
    least_words: int = 20, key: str = "doc_id",
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) as c0, c1, ... with n_words, n_features, weight, score and rank.

    ``weight`` sums the gains of all features of the text, ``score`` adds Gumbel noise, so the ``percent`` of the documents
    with at least ``least_words`` words that have the highest scores are a sample without replacement.  ``rank`` numbers
    them from 1; ties go to the smaller id, then to either row; it is null for all others.  Null and empty texts have no
    features and weight 0.  Repeated rows count each.  Rows without an id share one noise and come first in ties.  An empty
    target or table has no counts; an empty table gives an empty result.  Columns may have any names.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(key)]
    scanned = written(features(docs, longest, buckets), "features")
    wanted = features(target.select("text"), longest, buckets)
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(wanted, buckets))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("buckets")
            sums = np.concatenate([[0], np.cumsum(gain[of.flatten().to_numpy()])])
            at = of.offsets.to_numpy() - of.offsets[0].as_py()
            weight = sums[at[1:]] - sums[at[:-1]]
            luck = np.fromiter((noise(seed, i) for i in batch.column(own).to_pylist()), np.int64, batch.num_rows)
            added = [pa.array(np.diff(at), pa.int64()), pa.array(weight, pa.int64()), pa.array(weight + luck, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in (*names, "n_words")], *added], [*names, "n_words", "n_features", "weight", "score"])

    longs = [T.StructField(n, T.LongType()) for n in ("n_features", "weight", "score")]
    kinds = T.StructType([f for f in scanned.schema.fields if f.name != "buckets"] + longs)
    scored = written(scanned.mapInArrow(weigh, kinds).withColumn("row", F.monotonically_increasing_id()), "scored")
    out = [*names, "n_words", "n_features", "weight", "score"]

    able = scored.where(F.col("n_words") >= least_words).select((-F.col("score")).alias("low"), own, "row")
    order = ["low", own, "row"]
    placed = written(numbered(in_order(able, order, tasks_for(able, ROWS_PER_RANGE, able.sparkSession.sparkContext.defaultParallelism))), "placed")
    offsets = written(bases(placed, F.lit(1)), "offsets")
    draw = percent * (offsets.agg(F.sum("total")).first()[0] or 0) // 100
    if not draw:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    ranks = placed.join(broadcast_if_small(offsets), "part").select((F.col("base") + F.col("at") + 1).alias("rank"), *order)
    ranks = written(ranks.where(F.col("rank") <= draw), "ranks")
    cut = ranks.where(F.col("rank") == draw).select(*order)
    drawn = (F.col("n_words") >= least_words) & (
        F.struct((-F.col("score")).alias("low"), own, "row") <= cut.select(F.struct(*order)).scalar()
    )
    first = scored.where(drawn).join(broadcast_if_small(ranks.select("row", "rank"), 1_000_000), "row").select(*out, "rank")
    return first.union(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` under their own names, whole."""
    found = importance(docs, target, **options).where("rank IS NOT NULL")
    return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
