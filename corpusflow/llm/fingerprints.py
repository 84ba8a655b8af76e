"""Document fingerprints by one-permutation MinHash: one hash per shingle, optimal densification, packed low bits."""

from __future__ import annotations

import numpy as np

from corpusflow.llm.texts import LOWER, SPACED, mixed, shingle_sets, span_hashes, strings, word_spans

BIN_BITS = 8
LOW_BITS = 4
_VALUE = 63 - BIN_BITS
# Places that an empty bin looks at, one after the other; the same for all documents.
_TRIES = np.random.default_rng(17).integers(0, 1 << BIN_BITS, (1 << BIN_BITS, 64))


def densified(filled: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Every empty bin takes the value of the first filled bin in its own fixed sequence of places.

    Two documents with the same filled bins fill the rest alike, whatever the values: the estimate stays unbiased.
    """
    out, open_bins, n = values.copy(), np.flatnonzero(~filled), len(values)
    for tries in (_TRIES[:, :8], _TRIES[:, 8:]):
        if not len(open_bins):
            return out
        places = tries[open_bins]
        good = filled[places]
        at, done = good.argmax(1), good.any(1)
        out[open_bins[done]] = values[places[done, at[done]]]
        open_bins = open_bins[~done]
    if len(open_bins):  # few bins are filled: a rank among the filled ones by hash, also fixed per bin
        have = np.flatnonzero(filled)
        scores = mixed((open_bins[:, None] * n + have[None, :]).astype(np.uint64))
        out[open_bins] = values[have[scores.argmin(1)]]
    return out


def fingerprint(hashes: np.ndarray) -> bytes:
    """Packed low bits of the smallest hash of every bin, from sorted distinct 63-bit hashes; b"" for none."""
    if not len(hashes):
        return b""
    bins, first = np.unique(hashes >> _VALUE, return_index=True)  # hashes are sorted: the first of a bin is its minimum
    filled, values = np.zeros(1 << BIN_BITS, bool), np.zeros(1 << BIN_BITS, np.uint64)
    filled[bins] = True
    values[bins] = hashes[first].astype(np.uint64) & np.uint64((1 << _VALUE) - 1)
    # the bin's number goes into the bits, so that one value copied to many bins does not agree by chance in all of them
    own = np.arange(1 << BIN_BITS, dtype=np.uint64) << np.uint64(_VALUE)
    low = (mixed(densified(filled, values) | own) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def fingerprints(texts, shingle: int = 5) -> list[bytes]:
    """Fingerprints of an Arrow column of texts: lower-cased words between white space, ``shingle`` in a row.

    A text of fewer words has one shingle, a null, empty or blank text none and so an empty fingerprint.
    """
    data, offsets = strings(texts)
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets, SPACED)
    return [fingerprint(s) for s in shingle_sets(span_hashes(data, starts, ends), counts, shingle)]


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1.

    Two unequal minima agree in their low bits by chance; that share is taken off.  Two empty fingerprints are alike,
    an empty one and another are not.
    """
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    same = ((x & 15) == (y & 15)).sum() + ((x >> 4) == (y >> 4)).sum()
    chance = 2.0**-LOW_BITS
    return float(min(1.0, max(0.0, (same / (2 * len(x)) - chance) / (1 - chance))))
