"""Texts of an Arrow batch as byte arrays: words, word hashes and shingle hashes without a loop over words.

Null texts count as empty.  Words never cross the end of a text.  Hashes are the same in every process.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusflow.session import let_go

# Bytes that belong to words.  SPACED: all but ASCII white space.  ALNUM (after lower-casing): 0-9, a-z and every non-ASCII byte.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def powers(n: int, step: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and, per text, the number of words before it (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans must be in order, not empty and not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(heads, lengths)
    chosen = data[within + np.repeat(starts, lengths)]
    return mixed(np.add.reduceat(_BYTE[chosen] * powers(int(lengths.max()))[within], heads) + lengths.astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on, for the positions that have n."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    weights, size = powers(n, _GRAM), len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += hashes[j : j + size] * weights[j]
    return mixed(total + np.uint64(n))


def shingle_sets(words: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its n-word shingles as 63-bit values.

    A text of fewer than n words, but not none, has its whole sequence as the only shingle.
    """
    every = (grams(words, n) >> np.uint64(1)).astype(np.int64)
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield (grams(words[a:b], b - a) >> np.uint64(1)).astype(np.int64)
        else:
            yield np.zeros(0, np.int64)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1_000_000, keeps: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``most`` bytes of text (or of ids) each, or one row, so that arrays beside them stay bounded.

    What the worker keeps of other kinds than ``keeps`` for later tasks goes, and what is free goes back to the system before and
    after, so that the steps of a job don't add up.
    """
    let_go(keeps)
    give_back_memory()
    for batch in batches:
        if pa.types.is_list(batch.schema.field(column).type):
            at = batch.column(column).offsets.to_numpy().astype(np.int64) * 4
        else:
            _, at = strings(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    batch = at = None
    give_back_memory()


def give_back_memory() -> None:
    """Returns what a worker has freed to the system, where it can: workers live on, and the next task may be another's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array per row."""
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


class Remembered(dict):
    """Values of a function by its argument, made once each; of more than ``most`` the longest unused are forgotten.

    Arguments longer than ``longest`` are not remembered.
    """

    def __init__(self, make: Callable, most: int, longest: int | None = None) -> None:
        super().__init__()
        self.make, self.most, self.longest, self.before = make, most, longest, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        self[key] = value
        return value

    def trim(self) -> None:
        """To be called now and then: keys not asked for while half of ``most`` others were go."""
        if len(self) > self.most // 2:
            self.before = dict(self)
            self.clear()


SPECIAL = b"<|"


def pieces_of(texts: list[bytes]) -> list[list[bytes]]:
    """What stands between ASCII white space of each text, A-Z as a-z unless a special token's string could be meant."""
    return [(t if SPECIAL in t else t.lower()).split() for t in texts]
