"""Plain versions of the operators, and rows that are hard for all of them."""

import itertools
import re

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# nulls, empty, blank, tiny, repeated, very long and non-ASCII texts; doc_id 7 is a repeated row
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "two words"), (6, "é ü Ñ ñ 日本 語 🙂 x y"), (7, "same row twice, same row twice"),
    (7, "same row twice, same row twice"), (8, LONG), (9, LONG + " end"), (10, "One"), (-3, "a b c d e f g h i j k l m n o p"), (None, "no id at all here"),
]


def words(text, pattern=SPACED):
    return re.findall(pattern, (text or "").translate(A_TO_Z))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class Union:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_components(texts, n, percent):
    sets = {k: shingles(t, n) for k, t in texts.items()}
    union = Union(sets)
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            union.join(a, b)
    return {k: (len(s), union.find(k)) for k, s in sets.items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
