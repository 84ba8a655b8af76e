"""BPE ids by per-prefix dynamic programming: token matches of every prefix, pair compatibility, back-pointers."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable
from hashlib import sha256
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusflow.llm.tables import annotate, kept_by_worker
from corpusflow.llm.texts import Remembered, pieces_of

# Words, pieces of text and pairs of tokens that a worker remembers; beyond it the longest unused go.
REMEMBERED = 400_000
# Longer pieces, in bytes, seldom come again and take the most memory: only the words in them are remembered.
LONGEST = 48
_SIGNS = b"!\"#%&'()*+,-./:;=?"
# White space as the tokenizer's patterns mean it: Unicode White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
# Stands behind the last character of a word while matching; not a character of any token.
_END = "￿"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in shown else chr(0x100 + n))
        n += b not in shown
    return out


class SuffixAutomaton:
    """All substrings of a set of strings as states; read along a text, it knows which of the strings end at each place.

    A state stands for substrings that end at the same places of the strings; ``size`` is the longest one's length, and
    ``link`` the state of the longest suffix that ends at more places.  A whole string is the longest of its state, as
    nothing stands before it.
    """

    def __init__(self, strings: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        whole: dict[int, int] = {}
        for n, string in enumerate(strings):
            state = 0
            for c in string:
                state = self._after(state, c)
            whole[state] = n
        # (length, number) of all strings that are suffixes of a state's longest substring, longest first
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.size.__getitem__):  # links lead to shorter ones
            shorter = self.ends[self.link[state]]
            self.ends[state] = ((self.size[state], whole[state]), *shorter) if state in whole else shorter

    def _copy(self, state: int, size: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.size.append(size)
        return len(self.next) - 1

    def _redirect(self, state: int, c: str, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(c) == old:
            self.next[state][c] = new
            state = self.link[state]

    def _after(self, last: int, c: str) -> int:
        """The state of the string so far with one more character."""
        known = self.next[last].get(c)
        if known is not None and self.size[known] == self.size[last] + 1:
            return known
        if known is not None:  # a longer substring shares the state: part them
            apart = self._copy(known, self.size[last] + 1)
            self.link[known] = apart
            self._redirect(last, c, known, apart)
            return apart
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        state = last
        while state >= 0 and c not in self.next[state]:
            self.next[state][c] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][c]
            if self.size[there] > self.size[state] + 1:
                apart = self._copy(there, self.size[state] + 1)
                self.link[there] = apart
                self._redirect(state, c, there, apart)
                there = apart
            self.link[new] = there
        return new

    def matches(self, text: str) -> list[tuple[tuple[int, int], ...]]:
        """For every prefix of a text, (length, number) of the strings that end it, longest first."""
        follow, link, size, ends = self.next, self.link, self.size, self.ends
        state = length = 0
        out = []
        for c in text:
            after = follow[state].get(c)
            while after is None and state:
                state = link[state]
                length = size[state]
                after = follow[state].get(c)
            if after is not None:
                state, length = after, length + 1
            out.append(ends[state] if length == size[state] else ends[link[state]])
        return out


class WordBpe:
    """Encoder for a tokenizer file with lower-casing, a split into words and a suffix at word ends."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        marked = lambda s: s[: -len(suffix)] + _END if s.endswith(suffix) and s != suffix else s
        self.ids = {marked(s): i for s, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(marked(a), marked(b)): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**model["vocab"], **self.special}
        self.names = [""] * (max(names.values()) + 1)
        for s, i in names.items():
            self.names[i] = s
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]"))
        self.bytes = byte_characters()
        self.tokens = list(self.ids)
        self.tokens = [token for token in self.tokens if self.merged(token) == [token]]  # others never come out of the merges
        self.matches = SuffixAutomaton(self.tokens).matches
        self.fits = Remembered(lambda pair: self.compatible(pair >> 32, pair & 0xFFFFFFFF), REMEMBERED)
        self.words = Remembered(self.word, REMEMBERED)
        self.pieces = Remembered(self.piece, REMEMBERED, LONGEST)
        # whether ASCII letters are words as they stand, and punctuation behind them is apart
        self.apart = all(self.split.findall(ascii_lowercase + sign) == [ascii_lowercase, sign] for sign in _SIGNS.decode())

    def merged(self, text: str) -> list[str]:
        """The merges applied to a short string, lowest rank first and leftmost first."""
        parts = list(text)
        if len(parts) > 1 and parts[-1] == _END:
            parts[-2:] = [parts[-2] + _END]
        while len(parts) > 1:
            ranks = [self.rank.get(p, -1) for p in zip(parts, parts[1:], strict=False)]
            low = min((r for r in ranks if r >= 0), default=-1)
            if low < 0:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of tokens a and b side by side leave them as they are."""
        left, right = self.tokens[a], self.tokens[b]
        return self.merged(left + right) == [left, right]

    def word(self, word: str) -> bytes:
        """Ids of a word.  For every prefix there is one possible last token; the word's tokens follow from the end."""
        # printable ASCII characters stand for themselves
        text = (word if word.isascii() and word.isprintable() else "".join([self.bytes[b] for b in word.encode()])) + _END
        fits, last = self.fits, [-1] * (len(text) + 1)
        for at, ending in enumerate(self.matches(text), 1):
            for size, token in ending:
                if size == at or ((before := last[at - size]) >= 0 and fits[before << 32 | token]):
                    last[at] = token
                    break
        out, at = [], len(text)
        while at:
            token = self.tokens[last[at]] if last[at] >= 0 else None
            if token is None:
                raise ValueError(f"no encoding of {word!r}")
            out.append(self.ids[token])
            at -= len(token)
        return array("i", out[::-1]).tobytes()

    def plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            # lower case character by character: no special form at the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        words = self.split.findall(text.lower())
        # a piece that is one word is remembered as a piece, not once more as a word
        return [self.word(words[0])] if len(words) == 1 else [self.words[word] for word in words]

    def piece(self, piece: bytes) -> bytes:
        """Ids of a piece of text without ASCII white space; the strings of special tokens become those tokens."""
        if self.apart:
            if piece.isalpha():  # remembered as a piece, not once more as a word
                return self.word(piece.lower().decode())
            core = piece.rstrip(_SIGNS)
            if len(core) < len(piece) and core[-1:].isalpha():
                return self.pieces[core] + self.pieces[piece[len(core) :]]
        out, at, text = [], 0, piece.decode()
        if self.specials is not None and "<" in text:
            for m in self.specials.finditer(text):
                out += self.plain(text[at : m.start()])
                out.append(array("i", [self.special[m[0]]]).tobytes())
                at = m.end()
        return b"".join(out + self.plain(text[at:]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts.

        No token, no composition of characters and no special token's string goes across ASCII white space, so each distinct
        piece between it is encoded once, as long as it is remembered.
        """
        pieces = pieces_of(texts)
        out = [b"".join(map(self.pieces.__getitem__, p)) for p in pieces]
        self.pieces.trim()
        self.words.trim()
        self.fits.trim()
        return out


def definition(path: str) -> str:
    """A tokenizer file as text; a few MB, read once where the query is made."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded_column(column: pa.Array, bpe: WordBpe) -> pa.Array:
    """Ids of every text of a column."""
    ids = bpe.encode(column.cast(pa.large_binary()).fill_null(b"").to_pylist())
    at = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encoded(docs: DataFrame, tokenizer: str, back: bool = False) -> DataFrame:
    """Rows of ``docs`` as :func:`annotate` gives them, with ``tokens``: the ids of the whole text (null: empty).

    With ``back`` there is also ``decoded``: what the ids decode to.  Repeated rows count each; an empty table gives an empty
    result; columns may have any names.
    """
    shared, digest = docs.sparkSession.sparkContext.broadcast(tokenizer), sha256(tokenizer.encode()).hexdigest()

    def encode(column: pa.Array) -> list[pa.Array]:
        # the encoder and the words it remembers serve all tasks of a worker
        ids = encoded_column(column, kept_by_worker("bpe", digest, lambda: WordBpe(shared.value)))
        return [ids, kept_by_worker("names", digest, lambda: decoder(shared.value))(ids)] if back else [ids]

    added = {"tokens": T.ArrayType(T.IntegerType())} | ({"decoded": T.StringType()} if back else {})
    return annotate(docs, "text", encode, added, keeps=("bpe", "names"))


def decoder(tokenizer: str) -> Callable[[pa.Array], pa.Array]:
    """A function that turns columns of id lists into texts: the tokens' names with spaces between, special ones too.

    The tokenizer file names no decoder, so word ends and byte characters stay as the vocabulary writes them.
    """
    spec = json.loads(tokenizer)
    every = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    names = [""] * (max(every.values()) + 1)
    for s, i in every.items():
        names[i] = s

    def decode(column: pa.Array) -> pa.Array:
        words = pa.array(names, pa.string()).take(column.values)
        return pc.binary_join(pa.ListArray.from_arrays(column.offsets, words), " ")

    return decode
