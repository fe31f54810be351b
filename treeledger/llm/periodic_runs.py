"""Runs in the words of texts: stretches that repeat with a period four times or more.

Common extensions of two places are found by a difference cover: of all suffixes only those that start at places whose
remainder lies in the cover are sorted. Any two places reach a pair of such places within a block of the cover's modulus;
the words up to there are compared one by one, and what goes on from there is the least common prefix of a range of the
sorted suffixes, read from a sparse table. Suffixes are sorted, and the table built, only in a text where some pair of
places is equal all the way to its samples. The same on the reversed words extends to the left.

A run of period q and exponent 4 or more holds a place i with i a multiple of 3q, and i and i + q inside it. So each
period q looks at every 3q-th place: a harmonic sum, n log n places in all. Where the words at i and i + q agree, they are
extended both ways; what is long enough is a run, kept at its smallest period.

A text is a row and is worked on whole; the grid of a long text is visited in bounded pieces.

Cases: a null text has no words; a null id counts as the text '' in the damage; repeated rows stay rows of their own; an
empty table gives no rows; other columns are ignored, whatever their names. Ties for the strongest run go to the smallest
start, then the smallest period.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, map_rows

LEAST, TIMES = 6, 4
MODULUS = 31
#: Places of the grid that are looked at together.
GRID = 1 << 18
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def _cover(modulus: int) -> np.ndarray:
    """The first set of remainders, by size, among whose differences each remainder is."""
    size = int(np.sqrt(modulus))
    while True:
        for rest in itertools.combinations(range(2, modulus), size - 2):
            cover = (0, 1, *rest)
            if len({(a - b) % modulus for a in cover for b in cover}) == modulus:
                return np.array(cover)
        size += 1


COVER = _cover(MODULUS)
#: For remainders a and b: the least step that takes both into the cover.
STEP = np.array(
    [
        [next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)]
        for a in range(MODULUS)
    ]
)


class Extensions:
    """Lengths of common prefixes of suffixes of a sequence of numbers."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.rank = None

    def _samples(self) -> None:
        """Sort the suffixes at the cover's places: first by a block of words, then by doubling, as a place of the cover
        plus a block is one again. Common prefixes of neighbours follow from the same doubling."""
        n, v = self.n, MODULUS
        at = np.flatnonzero(np.isin(np.arange(n) % v, COVER))
        padded = np.concatenate([self.words + 1, np.zeros(2 * v, self.words.dtype)])
        block = padded[at[:, None] + np.arange(v)]
        order = np.lexsort(block.T[::-1])
        new = np.ones(len(at), bool)
        new[1:] = (block[order][1:] != block[order][:-1]).any(1)
        where = np.full(n + v, -1)  # place -> its number among the samples
        where[at] = np.arange(len(at))
        ranks = np.empty(len(at), np.int64)
        ranks[order] = np.cumsum(new) - 1
        levels, width = [ranks], v
        while ranks.max(initial=0) < len(at) - 1:
            nxt = at + width
            follow = np.where(nxt < n, where[np.minimum(nxt, n)], -1)
            second = np.where(follow >= 0, ranks[follow] + 1, 0)
            pair = ranks * (len(at) + 1) + second
            _, ranks = np.unique(pair, return_inverse=True)
            levels.append(ranks)
            width *= 2
        order = np.argsort(ranks)
        self.rank = np.full(n + 1, -1)
        self.rank[at] = ranks
        a, b = at[order[:-1]].copy(), at[order[1:]].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):  # equal blocks of v * 2**k words
            inside = (a < n) & (b < n)
            x, y = where[np.minimum(a, n)], where[np.minimum(b, n)]
            same = inside & (levels[k][x] == levels[k][y]) & (np.maximum(a, b) + v * (1 << k) <= n)
            step = np.where(same, v << k, 0)
            common, a, b = common + step, a + step, b + step
        alive = np.arange(len(a))
        for _ in range(v):  # the rest is shorter than a block
            alive = alive[(np.maximum(a[alive], b[alive]) < n)]
            alive = alive[self.words[a[alive]] == self.words[b[alive]]]
            if not len(alive):
                break
            common[alive] += 1
            a[alive] += 1
            b[alive] += 1
        table, k = [common], 1
        while 2 * k <= len(common):
            table.append(np.minimum(table[-1][:-k], table[-1][k:]))
            k *= 2
        self.table = table

    def _of_samples(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.rank is None:
            self._samples()
        lo, hi = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((hi - lo).astype(float))[1] - 1  # floor of the binary logarithm
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][lo[m]], self.table[k][hi[m] - (1 << k)])
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at i and j, i < j <= n."""
        n, words = self.n, self.words
        step = STEP[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        alive = np.arange(len(i))
        for k in range(MODULUS):
            if not len(alive):
                return out
            done = step[alive] == k
            if done.any():
                at = alive[done]
                inside = at[(j[at] + k) < n]
                out[inside] = k + self._of_samples(i[inside] + k, j[inside] + k)
                alive = alive[~done]
            alive = alive[j[alive] + k < n]
            alive = alive[words[i[alive] + k] == words[j[alive] + k]]
            out[alive] = k + 1
        return out


def _grid(n: int, size: int):
    """Pairs (place, period) of all periods, in pieces of about size."""
    last = n // TIMES
    q = 1
    while q <= last:
        # so many periods at once that their places fill a piece
        per = -(-n // (3 * q))
        many = min(last - q + 1, max(1, size // max(1, per)))
        periods = np.arange(q, q + many)
        counts = np.maximum(0, -(-(n - periods) // (3 * periods)))
        for first in range(0, int(counts.max(initial=0)), size) if many == 1 else (0,):
            if many == 1:
                places = np.arange(first, min(first + size, int(counts[0]))) * (3 * q)
                yield places, np.full(len(places), q)
            else:
                p = np.repeat(periods, counts)
                offset = np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield offset * 3 * p, p
        q += many


def runs(words: np.ndarray, grid: int = GRID) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of numbered words, by start, then period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    right = left = None
    for places, periods in _grid(n, grid):
        m = words[places] == words[places + periods]
        i, q = places[m], periods[m]
        # of 3q equal pairs or more around i, at least one more lies next to it on the longer side
        after, before = np.minimum(i + q + 1, n - 1), np.maximum(i - 1, 0)
        m = (words[i + 1] == words[after]) & (i + q + 1 < n) | (words[before] == words[before + q]) & (i > 0)
        i, q = i[m], q[m]
        if not len(i):
            continue
        if right is None:
            right, left = Extensions(words), Extensions(np.ascontiguousarray(words[::-1]))
        ahead = right.of(i, i + q)
        behind = left.of(n - i - q, n - i)  # words before i and i + q, read backwards
        length = ahead + behind + q
        m = length >= np.maximum(LEAST, TIMES * q)
        for s, size, p in zip((i - behind)[m].tolist(), length[m].tolist(), q[m].tolist(), strict=True):
            if p < found.get((s, size), n + 1):
                found[s, size] = p
    return sorted((s, size, p) for (s, size), p in found.items())


def damaged(words: list[str], doc_id: int | None) -> list[str]:
    """For a tenth of the ids: the words from a place on are replaced by repeats of those that follow it."""
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // len(piece))))[: n - a]


def numbered(words: list[str]) -> np.ndarray:
    """Equal numbers for equal words."""
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run drops: of each run, only the first period stays."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, size, q in found:
        gone[s + q] += 1
        gone[s + size] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g] if found else words


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def describe(doc_id: int | None, text: str) -> tuple:
    words = damaged(WORD.findall(text), doc_id)
    found = runs(numbered(words))
    best = (None,) * 4
    if found:
        top = found[0]
        for s, size, q in found[1:]:
            if size * top[2] > top[1] * q:  # exact; ties stay with the first by start, then period
                top = (s, size, q)
        best = (*top, 1000 * top[1] // top[2])
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), *best, _sha(listed), _sha(" ".join(collapsed(words, found))))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli) and digests of all runs and of the words
    that stay, a row a document."""

    def make():
        return lambda rows: [describe(*r) for r in rows]

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text")).alias("text")), make, SCHEMA)
