"""Dictionary segmentation: a double-array trie finds all words, and the split that covers most text in fewest words stays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

DEFAULT = Path(__file__).parent.parent / "data" / "shop_words.txt"
_PARTS = re.compile(r"[A-Za-z0-9]+|[㐀-鿿]+")
#: Characters that write a number together.
NUMERALS = frozenset("零〇一二两三四五六七八九十百千万亿半")


class Trie:
    """Words as a double array: from state s the character with code c leads to ``base[s] + c`` if ``check`` there is s.

    Characters are numbered by their frequency in the words. ``kind`` is 1 for the end of a word, 2 for that of a measure word, else 0.
    """

    def __init__(self, words: Iterable[tuple[str, bool]]):
        kinds: dict[str, int] = {}
        for word, measure in words:
            if word:
                kinds[word] = max(kinds.get(word, 0), 1 + measure)
        counts: dict[str, int] = {}
        for word in kinds:
            for c in word:
                counts[c] = counts.get(c, 0) + 1
        self.codes = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
        spelled = sorted((tuple(self.codes[c] for c in word), kind) for word, kind in kinds.items())
        size = 1024 + 4 * sum(len(w) for w, _ in spelled) + len(self.codes)
        self._base, self._check, self._kind = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int8)
        self._check[0] = 0
        self._free = 1
        stack = [(0, 0, len(spelled), 0)]
        while stack:
            state, low, high, depth = stack.pop()
            if len(spelled[low][0]) == depth if low < high else False:
                self._kind[state] = spelled[low][1]
                low += 1
            if low == high:
                continue
            groups, at = [], low
            while at < high:
                code, first = spelled[at][0][depth], at
                while at < high and spelled[at][0][depth] == code:
                    at += 1
                groups.append((code, first, at))
            base = self._place([g[0] for g in groups])
            self._base[state] = base
            self._check[[base + g[0] for g in groups]] = state
            stack += [(base + code, first, last, depth + 1) for code, first, last in groups]
        used = int(np.flatnonzero(self._check >= 0).max()) + 1
        # Plain lists: a walk reads single numbers.
        self.base, self.check, self.kind = (x[: used + len(self.codes) + 1].tolist() for x in (self._base, self._check, self._kind))
        del self._base, self._check, self._kind

    def _place(self, codes: list[int]) -> int:
        """The first base at which all codes fall on free places."""
        while self._check[self._free] >= 0:
            self._free += 1
        base = max(1, self._free - codes[0])
        while True:
            if base + codes[-1] >= len(self._check):
                more = len(self._check)
                self._base, self._kind = np.append(self._base, np.zeros(more, np.int32)), np.append(self._kind, np.zeros(more, np.int8))
                self._check = np.append(self._check, np.full(more, -1, np.int32))
            if (self._check[[base + c for c in codes]] < 0).all():
                return base
            base += 1

    def matches(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """End and kind of each word that begins at a place of a text."""
        state, base, check, kind, codes = 0, self.base, self.check, self.kind, self.codes
        for end in range(at, len(text)):
            code = codes.get(text[end])
            if code is None:
                return
            state_to = base[state] + code
            if state_to >= len(check) or check[state_to] != state:
                return
            state = state_to
            if kind[state]:
                yield end + 1, kind[state]


def read_words(spark: SparkSession, path: str, most: int = 2_000_000) -> list[tuple[str, bool]]:
    """The words of a dictionary file that Spark reads: a word a line, ``m`` after a tab for measure words, notes from ``#`` on.

    A dictionary goes to the driver and to every task, so it may have ``most`` lines at most.
    """
    lines = [r[0] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"a dictionary of more than {most} lines")
    return parse_words(lines)


def parse_words(lines: Iterable[str]) -> list[tuple[str, bool]]:
    parts = (line.split("#")[0].strip().split("\t") for line in lines)
    return [(p[0].strip(), p[1:2] == ["m"]) for p in parts if p[0].strip()]


def _numeral_end(text: str, at: int) -> int:
    while at < len(text) and text[at] in NUMERALS:
        at += 1
    return at


class Segmenter:
    """Cuts texts into words: runs of Latin letters and digits in lower case, and runs of CJK characters by a dictionary.

    Of all splits of a run the one stays whose dictionary words and numerals cover most characters; of these, that of
    fewest words; then that of the largest product of their lengths, so of the most even ones; then that whose longer
    words come later. Characters that no word covers are words of their own. A number, in digits or numerals, and the
    measure word after it are one word. Time grows with the length of the text times that of the longest word.
    """

    def __init__(self, words: Iterable[tuple[str, bool]]):
        self.trie = Trie(words)

    def edges(self, text: str) -> list[list[tuple[int, int]]]:
        """For each place of a CJK run the ends and kinds of the words and whole numerals that begin there."""
        found = []
        for at in range(len(text)):
            here = dict(self.trie.matches(text, at))
            if text[at] in NUMERALS and (at == 0 or text[at - 1] not in NUMERALS):
                here.setdefault(_numeral_end(text, at), 3)
            found.append(sorted(here.items()))
        return found

    def split(self, text: str) -> list[tuple[str, int]]:
        """The words of a CJK run with their kinds: 0 for a character without a word, 1 a word, 2 a measure word, 3 a numeral."""
        # best[i]: of the splits of the first i characters (covered, -words, product of lengths, places times lengths), and the last step.
        best: list[tuple[tuple[int, int, int, int], int, int] | None] = [None] * (len(text) + 1)
        best[0] = ((0, 0, 1, 0), 0, 0)
        for at, ends in enumerate(self.edges(text)):
            covered, words, product, weight = best[at][0]
            single = ((covered, words, product, weight), at, 0)
            if best[at + 1] is None or single[0] > best[at + 1][0]:
                best[at + 1] = single
            for end, kind in ends:
                size = end - at
                value = (covered + size, words - 1, product * size, weight + (1 - words) * size)
                if best[end] is None or value > best[end][0]:
                    best[end] = (value, at, kind)
        out, at = [], len(text)
        while at:
            _, before, kind = best[at]
            out.append((text[before:at], kind))
            at = before
        return out[::-1]

    def __call__(self, text: str | None) -> list[str]:
        words: list[tuple[str, int, int]] = []  # with kind and end; digits are numerals, too
        for part in _PARTS.finditer(text or ""):
            if part[0].isascii():
                words.append((part[0].lower(), 3 if part[0].isdigit() else 1, part.end()))
                continue
            at = part.start()
            for word, kind in self.split(part[0]):
                at += len(word)
                if kind == 2 and words and words[-1][1] == 3 and words[-1][2] == at - len(word):
                    words[-1] = (words[-1][0] + word, 1, at)
                elif kind == 3 and words and words[-1][1] == 3 and words[-1][2] == at - len(word):
                    words[-1] = (words[-1][0] + word, 3, at)
                else:
                    words.append((word, kind, at))
        return [w for w, _, _ in words]


def default_words() -> list[tuple[str, bool]]:
    """The small dictionary of shop words that comes with the library."""
    return parse_words(DEFAULT.read_text(encoding="utf-8").splitlines())
