"""Document quality by attention-based multiple-instance learning: passages are instances, documents carry the labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import annotate, only_keys, written
from corpusflow.llm.texts import LOWER, SPACED, grams, slices, span_hashes, strings, word_spans

PASSAGE_WORDS = 64
# Labelled documents that the model is fitted on: those with the smallest hashes of their ids.
TRAIN_DOCS = 4_000
PAIR_BINS = 192
HIDDEN = 24
ATTENTION = 12
_SHAPES = 12
N_FEATURES = 128 + PAIR_BINS + _SHAPES


def passages(column: pa.Array, words_each: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text and, per text, the number of passages before it.

    A passage is ``words_each`` words in a row; a text without words has one passage of zeros.  Features: shares of ASCII
    byte values and of hashed pairs of character classes, and shapes: word lengths, capitals, marks, line breaks, and how
    many words and word pairs of the passage stood in it or in the text before.
    """
    raw, offsets = strings(column)
    starts, ends, counts = word_spans(raw, offsets, SPACED)
    n_words = np.diff(counts)
    n_passages = np.maximum(1, -(-n_words // words_each))
    before = np.concatenate([[0], np.cumsum(n_passages)])
    out = np.zeros((before[-1], N_FEATURES), np.float32)
    if not len(starts):
        return out, before
    owner = np.repeat(np.arange(len(n_words)), n_words)
    rank = np.arange(len(starts)) - counts[owner]
    passage = before[owner] + rank // words_each
    # bytes from a passage's first word to its last
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    last = np.append(first[1:], len(starts)) - 1
    names = passage[first]
    sizes = ends[last] - starts[first]
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[first], sizes)
    where, seen = np.repeat(names, sizes), raw[at]
    total = len(out)
    size = np.maximum(np.bincount(where, minlength=total), 1)[:, None]
    ascii_ = seen < 128
    out[:, :128] = np.bincount(where[ascii_] * 128 + seen[ascii_], minlength=total * 128).reshape(total, 128) / size
    classes = _CLASSES[seen].astype(np.int64)
    same = where[1:] == where[:-1]
    pair = (classes[:-1] * 14 + classes[1:]) % PAIR_BINS
    out[:, 128 : 128 + PAIR_BINS] = np.bincount((where[:-1] * PAIR_BINS + pair)[same], minlength=total * PAIR_BINS).reshape(total, PAIR_BINS) / size
    lowered = LOWER[raw]
    hashes = span_hashes(lowered, starts, ends)
    pairs = grams(hashes, 2)
    pair_owner = owner[: len(pairs)]
    inside = owner[: len(pairs)] == owner[1 : len(pairs) + 1]

    def repeated(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Whether the same value stood earlier in its group."""
        order = np.lexsort((np.arange(len(values)), values, groups))
        again = (values[order][1:] == values[order][:-1]) & (groups[order][1:] == groups[order][:-1])
        flags = np.zeros(len(values), bool)
        flags[order[1:][again]] = True
        return flags

    share = lambda flags, of: np.bincount(of, flags, total) / np.maximum(np.bincount(of, minlength=total), 1)
    lengths = (ends - starts).astype(float)
    heads, tails = raw[starts], raw[ends - 1]
    shapes = [
        share(lengths / 10, passage),
        np.sqrt(np.maximum(share(lengths**2 / 100, passage) - share(lengths / 10, passage) ** 2, 0)),
        share((heads >= 65) & (heads < 91), passage),
        share((tails == 46) | (tails == 33) | (tails == 63), passage),
        share(lengths == 1, passage),
        share(~_LETTER[heads] & (lengths <= 3), passage),
        share(repeated(hashes, passage), passage),
        share(repeated(hashes, owner), passage),
        share(repeated(pairs, pair_owner) & inside, passage[: len(pairs)]) if len(pairs) else np.zeros(total),
        np.bincount(where, seen == 10, total) / size[:, 0] * 10,
        np.bincount(where, (seen >= 65) & (seen < 91), total) / size[:, 0],
        np.bincount(where, seen >= 128, total) / size[:, 0],
    ]
    out[:, 128 + PAIR_BINS :] = np.stack(shapes, 1)
    return out, before


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
# Character classes for pairs: lower, upper, digit, space, line break, other bytes by their low bits.
_CLASSES = np.array([0 if 97 <= b < 123 or b >= 128 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b == 32 else 4 if b == 10 else 5 + b % 9 for b in range(256)], np.uint8)


@dataclass
class AttentionModel:
    """h = tanh(x W + b); weight of a passage ~ exp(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum(weight * h) + d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["w"]
        owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
        e = np.exp(a - np.maximum.reduceat(a, before[:-1])[owner])
        weight = e / np.add.reduceat(e, before[:-1])[owner]
        m = np.add.reduceat(weight[:, None] * h, before[:-1])
        p = 1 / (1 + np.exp(-np.clip(m @ w["c"] + w["d"][0], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "owner": owner, "weight": weight, "m": m, "p": p}

    def scores(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.forward(x, before)["p"]

    def gradients(self, x: np.ndarray, before: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        f, w = self.forward(x, before), self.weights
        err = (f["p"] - y) / len(y)
        h, own, weight = f["h"], f["owner"], f["weight"]
        dm = err[:, None] * w["c"]
        to_h = np.einsum("ij,ij->i", dm[own], h)
        mean_h = np.add.reduceat(weight * to_h, before[:-1])
        da = weight * (to_h - mean_h[own])
        dt, dg = da[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (weight[:, None] * dm[own] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        grads = {
            "W": f["z"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg,
            "w": (f["t"] * f["g"]).T @ da, "c": f["m"].T @ err, "d": np.array([err.sum()]),
        }
        return {k: v + decay * w[k] * (k in "WVUc") for k, v in grads.items()}


def fitted(x: np.ndarray, before: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, seed: int = 5) -> AttentionModel:
    """Gradient descent with momentum and step sizes per weight, over shuffled documents."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    weights = {
        "W": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION),
        "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32),
    }
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = AttentionModel(mean.astype(np.float32), scale.astype(np.float32), weights)
    if not len(y) or y.min() == y.max():
        # one kind of label, or none: its smoothed share for every text
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights["c"][:] = 0
        weights["d"][:] = np.log(share / (1 - share))
        return model
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            docs = order[a : a + batch]
            sizes = np.diff(before)[docs]
            inner = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(inner[-1]) + np.repeat(before[docs] - inner[:-1], sizes)
            step += 1
            rate = 4e-3 * (1 - step / (steps + 1))
            for k, g in model.gradients(x[rows], inner, y[docs], 1e-4).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                fair = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
                weights[k] -= (rate * fair[0] / (np.sqrt(fair[1]) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> AttentionModel:
    """A model from at most ``train_docs`` labelled documents: ``labels`` (doc_id, quality 0/1) tell which to learn from.

    The sample is those with the smallest hashes of doc_id.  Null labels are ignored; a document with several labels has
    their mean.  The passages of the sample come to the driver, whole texts of a bounded number of documents.
    """
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    chosen = labels.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    chosen = written(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs), "sample")
    texts = only_keys(docs.select("doc_id", "text"), chosen, "doc_id").join(chosen, "doc_id").select("text", "y")

    def encode(batches):
        for batch in slices(batches):
            x, before = passages(batch.column("text"))
            rows = [x[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.binary())], ["y", "x"])

    rows = texts.mapInArrow(encode, "y double, x binary").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))  # the fit depends on the sample alone
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    before = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    x = np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)
    return fitted(x, before, np.array([r["y"] for r in rows], np.float32))


def scored(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """Rows of ``docs`` as :func:`annotate` gives them, with score: how likely the whole text is of quality 1.

    Null, empty and blank texts have one passage of zeros and so a score as well.
    """
    mean, scale, weights = model.mean, model.scale, model.weights

    def score(column: pa.Array) -> list[pa.Array]:
        x, before = passages(column)
        return [pa.array(AttentionModel(mean, scale, weights).scores(x, before).astype(float), pa.float64())]

    return annotate(docs, "text", score, {"score": T.DoubleType()})
