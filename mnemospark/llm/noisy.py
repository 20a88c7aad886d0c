"""Noisy-channel restoration of disguised words: a Viterbi search over character lattices.

A disguised word (leetspeak, letters drawn apart, letters repeated) is read as a lattice: each
observed character offers letters at a cost, a run of one letter may stand for one or two, and
separators between letters may be nothing. The path of least cost under a character trigram
model is the restored word.
"""

from __future__ import annotations

import re

import numpy as np

#: Letters of the model: a-z, every other letter as one, and the edge of a word.
OTHER, EDGE, SIZE = 26, 27, 28
#: Letters that a digit or sign stands for in disguised writing.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "€": "e", "*": "aeiou", "%": "o",
}
#: Costs in nats: a sign read as a letter, a wildcard as one of its letters, a separator dropped, a run shortened.
SIGN, WILD, DROP, SHORT = 1.0, 2.5, 0.5, 0.5
#: Longest stretch that is decoded as one word, in runs of one character; longer ones are decoded in parts.
LONGEST = 40

_table = np.full(65536, EDGE, np.int64)
for _c in range(65536):
    if chr(_c).isalpha():
        _table[_c] = ord(chr(_c).lower()) - 97 if chr(_c).isascii() else OTHER

apart = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?![^\W_])")
token = re.compile(r"\S+")
run = re.compile(r"(.)\1{2,}")
long_run = re.compile(r"(.)\1{3,}", re.S)
single = re.compile(r"(.)\1*", re.S)
#: Cuts a long stretch; none of these stands for a letter.
between = re.compile(r"[^\w@$!|+(<#€*%]+|_+")
outer = "\"'.,;:!?()[]{}<>*#$%&|-_~`^=/\\"


def letters(text: str) -> np.ndarray:
    """Model letters of a text; what is no letter is an edge."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _table[np.minimum(codes, 65535)]


def trigram_counts(texts) -> np.ndarray:
    """Counts of character trigrams over words, edges included twice before a word."""
    out = np.zeros(SIZE**3, np.int64)
    for t in texts:
        a = letters(f" {t} ")
        out += np.bincount((a[:-2] * SIZE + a[1:-1]) * SIZE + a[2:], minlength=SIZE**3)
    return out


def costs(counts: np.ndarray) -> np.ndarray:
    """Costs -ln p(third | first two), mixed with the pair's so that none is infinite."""
    c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    pair = (c.sum(0) + 0.5) / (c.sum(0) + 0.5).sum(1, keepdims=True)
    return -np.log((c + 5 * pair[None]) / (c.sum(2, keepdims=True) + 5))


def lattice(word: str) -> list[list[tuple[float, tuple[int, ...]]]]:
    """For each run of equal characters, the (cost, letters) it may stand for."""
    out, at = [], 0
    while at < len(word):
        end = at
        while end < len(word) and word[end] == word[at]:
            end += 1
        c, n = word[at], end - at
        if c.isalpha():
            k = int(_table[min(ord(c), 65535)])
            choices = [(SHORT * (n > 1), (k,))] + ([(SHORT * (n > 2), (k, k))] if n > 1 else [])
        else:
            choices = [(DROP, ())] if not c.isalnum() or c not in LEET else []
            for x in LEET.get(c, ""):
                k, cost = ord(x) - 97, WILD if c == "*" else SIGN
                choices += [(cost, (k,))] + ([(cost, (k, k))] if n > 1 else [])
        out.append(choices)
        at = end
    return out


def restore(word: str, cost: np.ndarray) -> str:
    """The most likely plain word of a disguised one; other letters come back as '?'."""
    best: dict[tuple[int, int], tuple[float, str]] = {(EDGE, EDGE): (0.0, "")}
    for choices in lattice(word):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (so_far, text) in best.items():
            for extra, put in choices:
                x, y, total, out = a, b, so_far + extra, text
                for k in put:
                    total += cost[x, y, k]
                    out += chr(97 + k) if k < 26 else "?"
                    x, y = y, k
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = total, out
        best = after
    ends = [(total + cost[a, b, EDGE], text) for (a, b), (total, text) in best.items()]
    return min(ends)[1]


def runs_of(text: str) -> list[str]:
    return [m[0] for m in single.finditer(text)]


def parts(disguise: str) -> tuple[list[str], list[str]]:
    """(words, windows) that a stretch is decoded as, its runs shortened.

    Words are the stretch itself and, at every length, its pieces between separators; what has
    over LONGEST runs is decoded in overlapping windows instead. Pieces of plain letters stand
    for themselves and are left out.
    """
    short = long_run.sub(r"\1\1\1", disguise)  # the lattice tells no longer runs apart
    pieces = [x for x in between.split(short) if x]
    words, windows = [], []
    for x in dict.fromkeys([short, *(x for x in pieces if not x.isalpha() or run.search(x))]):
        runs = runs_of(x)
        if len(runs) <= LONGEST:
            words.append(x)
        elif x in pieces:
            windows += ["".join(runs[k : k + LONGEST]) for k in range(0, max(1, len(runs) - LONGEST // 2), LONGEST // 2)]
    return words, windows


class Restorer:
    """Restored words of texts, each distinct disguise decoded once while it is remembered."""

    def __init__(self, cost: np.ndarray, size: int = 200_000):
        self.cost, self.size, self.known = cost, size, {}

    def word(self, disguise: str) -> str:
        if disguise not in self.known:
            if len(self.known) > self.size:
                self.known.clear()
            self.known[disguise] = restore(disguise, self.cost)
        return self.known[disguise]

    def all(self, disguise: str) -> set[str]:
        """What a stretch of any length stands for; of a window, also what follows its first letters."""
        words, windows = parts(disguise)
        out = {self.word(x) for x in (*words, *windows)}
        for x in windows:
            if len(runs_of(x)) > LONGEST // 2:
                plain = self.word(x)
                out.update(plain[k:] for k in range(1, len(plain) - 3))
        return out

    def words(self, low: str) -> set[str]:
        """Distinct words of a text in lower case, and what its disguised ones stand for."""
        out = set()
        for t in set(low.split()):
            w = t.strip(outer)
            if w.isalpha():
                out.add(w)
                if run.search(w):
                    out.update(self.all(w))
            elif w:
                out.update(re.findall(r"[^\W\d_]+", w))
                out.update(self.all(w))
            if t != w and t[:1] in LEET:
                out.update(self.all(t.rstrip(outer)))
        for m in apart.finditer(low):
            drawn = re.sub(r"[ .\-_*]+", "", m[0])
            out.update(self.word(drawn[k : k + LONGEST]) for k in range(len(drawn) - 3))
        out.discard("")
        return out
