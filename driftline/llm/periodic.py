"""Periodic runs of words: stretches that repeat with a period, found by Lyndon words under both orders.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and of at least
``max(least, 2 * q)`` words, which no neighbouring word extends keeping period q. Every run has, under one of an order of
the words and its reverse, a Lyndon word of length q that starts in it and is the longest that starts there. So a text is
read from right to left once for each order, with a stack of the Lyndon words found so far (``following``); each of the
2n words found says a place and a period, and what repeats around it is compared both ways (``Repeats``).

How far two places agree is told by their first words, then by binary search over rolling hashes; the words themselves
confirm what the hashes say, so hashes decide nothing alone. What was found for a distance is kept as long as the
scan is within it: it is neither searched nor confirmed again.

A text is one row of one task: some 100 bytes a word, and a time that grows with n log n. Null and empty texts have no words
and no runs. Rows are answered one by one: repeated rows and ids, null ids and ties have no bearing on each other. Other
columns are not looked at and pass through; a column ``runs`` or ``collapsed`` of the input is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12
#: Words that are compared one by one before hashes are asked.
NEAR = 12
RUNS = T.ArrayType(T.StructType().add("start", T.LongType(), False).add("length", T.LongType(), False).add("period", T.LongType(), False), False)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers that look random, one for each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Repeats:
    """Stretches of places k of a sequence of word numbers at which words k and k + distance are the same."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.array = np.array(words, np.int64)
        self.known: dict[int, tuple[int, int]] = {}
        self.sums: np.ndarray | None = None

    def _same(self, i: int, j: int, size: int) -> bool:
        """Whether the hashes of ``size`` words from i and from j on are equal."""
        if self.sums is None:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, _ODD)]))
                self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(self.array) * self.powers[:-1])])
        with np.errstate(over="ignore"):
            return bool((self.sums[i + size] - self.sums[i]) * self.powers[j - i] == self.sums[j + size] - self.sums[j])

    def _search(self, most: int, same: Callable[[int], bool]) -> int:
        """The greatest size up to ``most`` with same(size); doubling steps first."""
        low, step = NEAR, NEAR
        while low < most and same(min(low + step, most)):
            low, step = min(low + step, most), 2 * step
        high = min(low + step, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if same(middle) else (low, middle)
        return low

    def around(self, i: int, distance: int) -> tuple[int, int]:
        """The longest such stretch with place i in it: its first place and its end. Words i and i + distance are the same."""
        known = self.known.get(distance)
        if known and known[0] <= i < known[1]:
            return known
        w, d, n = self.words, distance, self.n
        end, most = i + 1, min(n - d, i + NEAR)
        while end < most and w[end] == w[end + d]:
            end += 1
        first, least = i, max(0, i + 1 - NEAR)
        while first > least and w[first - 1] == w[first + d - 1]:
            first -= 1
        near = (first, end)
        if end == i + NEAR:
            end = i + self._search(n - d - i, lambda size: self._same(i, i + d, size))
        if i + 1 - first == NEAR:
            first = i + 1 - self._search(i + 1, lambda size: self._same(i + 1 - size, i + 1 - size + d, size))
        if (first, end) != near:
            a = self.array
            if not np.array_equal(a[first:end], a[first + d : end + d]):  # two hashes were equal by chance
                differ = np.flatnonzero(a[: n - d] != a[d:])
                at = int(np.searchsorted(differ, i))
                first, end = (int(differ[at - 1]) + 1 if at else 0), (int(differ[at]) if at < len(differ) else n - d)
            self.known[d] = (first, end)
        return first, end


def following(words: list[int], repeats: Repeats) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there, by the order of the numbers: the next place
    from which the rest of the sequence is smaller."""
    n = len(words)
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        own, j = words[i], i + 1
        while j < n:
            other = words[j]
            if own == other:
                k, m = i + 1, j + 1
                if m < n and words[k] == words[m]:
                    k = repeats.around(i, j - i)[1]
                    m = k + j - i
                # the rest from j on may be a beginning of the rest from i on: it's smaller then
                if m < n and words[k] < words[m]:
                    j = ends[j]
                    continue
                break
            if own > other:
                break
            j = ends[j]
        ends[i] = j
    return ends


def _may_be_long(a: np.ndarray, period: np.ndarray, least: int) -> np.ndarray:
    """For each place whether around it at least ``least`` places in a row repeat by its period."""
    n = len(a)
    padded = np.concatenate([np.full(least, -1), a, np.full(least, -2)])
    at = np.arange(n) + least
    count = np.zeros(n, np.int64)
    for steps in (range(least), range(-1, -least - 1, -1)):  # on from the place, back from the one before
        still = np.ones(n, bool)
        for k in steps:
            other = at + k + period
            still = still & (padded[at + k] == padded[np.minimum(other, n + least)])
            if not still.any():
                break
            count += still
    return count >= least


def runs(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < max(least, 2):
        return []
    repeats, found = Repeats(words), set()
    a, at = repeats.array, np.arange(n)
    for order in (words, [-x for x in words]):
        repeats.known.clear()
        period = np.array(following(order, repeats)) - at
        repeats.known.clear()
        some = np.flatnonzero(_may_be_long(a, period, (least + 1) // 2))
        # from right to left, as what is known of a distance follows the scan
        for i, p in zip(some[::-1].tolist(), period[some][::-1].tolist(), strict=True):
            first, end = repeats.around(i if i + p < n and words[i] == words[i + p] else i - 1, p)
            if end - first >= p and end - first + p >= least:
                found.add((first, end - first + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def surplus(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] > 0


def numbered(words: list[str]) -> list[int]:
    """Words as numbers, by first occurrence."""
    numbers: dict[str, int] = {}
    return [numbers.setdefault(w, len(numbers)) for w in words]


def periodic(docs: DataFrame, text: str = "text", least: int = LEAST, rewrite: Callable[..., list[str]] | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the text, with ``runs`` (start, length and period, by start, then period), and ``collapsed``: the
    words that no run contains after its first period, joined by a space. ``rewrite(words, *values of the columns given)``
    may change the words that are looked at."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "runs", "collapsed")]
    schema = T.StructType([*rest, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    names = [f.name for f in rest]

    def answer(said: str | None, *values) -> tuple[list[tuple[int, int, int]], str]:
        words = WORD.findall(said or "")
        if rewrite:
            words = rewrite(words, *values)
        found = runs(numbered(words), least)
        if found:
            words = [w for w, drop in zip(words, surplus(len(words), found).tolist(), strict=True) if not drop]
        return found, " ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = [b.column(c).to_pylist() for c in given]
            answers = [answer(*row) for row in zip(b.column(text).to_pylist(), *values, strict=True)]
            sizes = np.cumsum([0, *(len(f) for f, _ in answers)])
            flat = np.array([r for f, _ in answers for r in f], np.int64).reshape(-1, 3)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(x.name, pa.int64(), False) for x in RUNS.elementType.fields])
            lists = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), parts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), lists, pa.array([c for _, c in answers], pa.string())], [*names, "runs", "collapsed"])

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*names, *given, text])]).mapInArrow(run, schema)
