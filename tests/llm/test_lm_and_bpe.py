import collections
import functools
import math
import random
import zlib

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import bpe, ppm
from corpusflow.llm.queries import tokenizer_path

HARD_TEXTS = [
    "", None, "  ", "ΑΣ ΟΔΟΣ Σ.", "a<|endoftext|>B<|startoftext|>", "<|endoftext", "İstanbul ﬁ ①②٣", "é ́x Å", "tab\x1cx\x85y​z﻿",
    "it's WE'LL don't''s", "日本語テスト🙂\U0001f468‍\U0001f469", "￿ x￿", "\x00\x01\x7f", "ẞ ŉ ΐ", "a" * 300, "0123456789" * 20,
]


def test_ids_and_texts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = HARD_TEXTS + [t for _, t in brute.HARD]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    definition = bpe.definition(tokenizer_path())
    got = {r["c0"]: r["tokens"] for r in bpe.encoded(docs, definition).collect()}
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert got == want
    for few in (docs.limit(0), docs.union(docs).select("doc_id", "text", F.lit("x").alias("tokens"))):
        both = bpe.encoded(few, definition, back=True)
        assert [(r["c0"], r["decoded"]) for r in both.select("c0", "decoded").collect()] == [
            (r["doc_id"], library.decode(want[r["doc_id"]], skip_special_tokens=False)) for r in few.select("doc_id").collect()
        ]
    back = bpe.decoder(definition)(pa.array(list(want.values()), pa.list_(pa.int32()))).to_pylist()
    assert back == [library.decode(ids, skip_special_tokens=False) for ids in want.values()]


def test_a_worker_remembers_each_word_once():
    from corpusflow.llm import bpe

    encoder = bpe.WordBpe(bpe.definition(tokenizer_path()))
    texts = [" ".join(f"{a}{b}слово{b}" for a in "abcdefgh" for b in "ijklm"), "plain words and plain words, again", "x.y" * 40]
    first = encoder.encode([t.encode() for t in texts])
    assert encoder.encode([t.encode() for t in texts]) == first
    assert not {w.encode() for w in encoder.words} & encoder.pieces.keys()
    assert max(map(len, encoder.pieces)) <= bpe.LONGEST


def test_suffix_automaton_finds_all_strings():
    rng = random.Random(4)
    for _ in range(60):
        strings = list({"".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))})
        automaton = bpe.SuffixAutomaton(strings)
        for _ in range(20):
            text = "".join(rng.choices("abcd", k=rng.randrange(0, 30)))
            want = [sorted(((len(s), n) for n, s in enumerate(strings) if text[:i].endswith(s)), reverse=True) for i in range(1, len(text) + 1)]
            assert [list(m) for m in automaton.matches(text)] == want


def python_ppm(trains):
    seen = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    for text in trains:
        for i in range(ppm.ORDER, len(text)):
            seen[ppm.ORDER][text[i - ppm.ORDER : i]][text[i]] += 1
    for o in range(ppm.ORDER, 0, -1):  # a shorter context counts longer ones
        for context, by in seen[o].items():
            for byte in by:
                seen[o - 1][context[1:]][byte] += 1

    def part(o, context):
        """The discount of an order: of contexts with these last two bytes, or of all."""
        end = context[-2:] if o >= 2 else b""
        counts = [n for c, by in seen[o].items() if c.endswith(end) for n in by.values()]
        once, twice = counts.count(1), counts.count(2)
        return (once + ppm.PRIOR * ppm.PRIOR_WINDOWS) / (once + 2 * twice + ppm.PRIOR_WINDOWS)

    def log_p(context, byte):
        excluded, p = set(), 0.0
        for o in range(ppm.ORDER, -1, -1):
            counts = {b: n for b, n in seen[o].get(context[ppm.ORDER - o :], {}).items() if b not in excluded}
            total = sum(counts.values())
            if byte in counts:
                return p + math.log10((counts[byte] - part(o, context)) / total)
            if counts:
                p += math.log10(part(o, context) * len(counts) / total)
                excluded |= set(counts)
        return p - math.log10(256 - len(excluded))

    return functools.cache(log_p)


@pytest.mark.parametrize("block_bytes", [10**8, 150])
def test_scores_equal_brute_force(spark, block_bytes):
    texts = ["The cat sat on the mat.", "the  CAT sat\nthere", "a dog ran to the mat", "", None, "zzz zzz é", "the cat"] * 2
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = ppm.scores(docs.repartition(4), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, block_bytes).collect()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    tokens = {i: [*brute.words(t), None] for i, t in enumerate(texts)}
    count = collections.Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(count.values()), len(count)
    stream = {i: b"\xff" * ppm.ORDER + " ".join(ts[:-1]).encode() + b"\xff" for i, ts in tokens.items()}
    log_p = python_ppm([s for i, s in stream.items() if not held[i]])
    assert len(got) == len(texts)
    for r in got:
        i = r["doc_id"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(t in count for t in tokens[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i]))
        s = stream[i]
        assert r["score"] == pytest.approx(sum(log_p(s[k - ppm.ORDER : k], s[k]) for k in range(ppm.ORDER, len(s))))


def test_probabilities_of_a_context_sum_to_one():
    import numpy as np

    codes = np.array([int.from_bytes(b"abcde" + bytes([x]), "big") for x in range(256)], np.uint64)
    seen = {b"abcdef": 3, b"abcdeg": 1, b"xbcdeh": 2, b"xyzdei": 5}
    keys = np.unique(np.concatenate([codes, np.array([int.from_bytes(k, "big") for k in seen], np.uint64)]))
    counts = np.array([seen.get(int(k).to_bytes(6, "big"), 0) for k in keys])
    pairs = np.zeros((256, 256), np.int64)
    for k in {k[3:] for k in seen}:
        pairs[k[1], k[2]] += 1
    values = ppm.code_lengths(keys, counts, pairs)
    assert (10 ** values[np.isin(keys, codes)]).sum() == pytest.approx(1)


def test_hard_rows(spark):
    docs = spark.createDataFrame(brute.HARD, "doc_id long, text string")
    assert ppm.scores(docs, F.lit(False)).count() == len(brute.HARD)
    unlearned = [r["score"] for r in ppm.scores(docs, F.lit(True)).collect() if r["n_tokens"] == 1]
    assert unlearned == pytest.approx([-math.log10(256)] * len(unlearned)) and unlearned
    assert ppm.scores(docs.limit(0), F.lit(False)).count() == 0
