"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with every run of white space as one space, trimmed. An item of n characters may have
e = floor(``rate`` * n) edits (insertions, deletions, substitutions). Cut into e + 1 pieces, at least one piece of it
then stands unchanged in any document that holds it, and close to its place. An Aho-Corasick automaton finds all pieces
in one pass over a whole document; where a piece is found, Myers' bit-parallel distance of the item against the
surrounding stretch (item length and e more characters to either side) says whether, and how closely, it is there.

Items go to the tasks in groups of about ``GROUP_CHARS`` / 2 characters, so that no automaton outgrows a task, however
large the benchmark is. A benchmark of one group takes one scan of the documents; of more, one scan a group, whose matches
are written before the next group is fetched. A piece that is very common costs no more than one distance for each stretch
of the document: hits of an item whose stretches overlap are verified as one stretch.

Cases: null and blank texts match nothing; items that are blank after normalising are left out. Equal items are items of
their own; repeated documents give rows of their own. A null doc_id or item_id stays null. Empty tables give no rows.
Columns other than doc_id, text and item_id, text are ignored by ``matches`` and handed on by ``decontaminate``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, map_rows, materialize, only, packed, row_key, scratch, unpacked

RATE = 0.07
GROUP_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float = RATE) -> int:
    return int(n * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and where the first such substring ends. A column of
    the distance matrix is two bit vectors of its vertical differences."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | (1 << i)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        h_minus = plus & d
        h_plus = (minus | ~(plus | d)) & full
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full  # row 0 costs nothing: the match may start anywhere
        minus = h_plus & d
        plus = ((h_minus << 1) | ~(h_plus | d)) & full
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """The automaton of a group of items, built once in a task."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        self.auto = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for off, p in pieces(t, e):
                at.setdefault(p, []).append((k, off))
        for p, where in at.items():
            self.auto.add_word(p, (len(p), where))
        self.auto.make_automaton()

    def __call__(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normalised text) for each item that is in the text."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for last, (n, where) in self.auto.iter(text):
            for k, off in where:
                _, t, e = self.items[k]
                a = last + 1 - n - off
                hits.setdefault(k, []).append((max(0, a - e), a + len(t) + e))
        out = []
        for k, spans in hits.items():
            item_id, t, e = self.items[k]
            best = None
            spans.sort()
            a, b = spans[0]
            for x, y in [*spans[1:], (len(text) + 1, 0)]:
                if x <= b and y:
                    b = max(b, y)
                    continue
                d, end = myers(t, text[a:b])
                if d <= e and (best is None or d < best[0]):
                    best = (d, a + end)
                a, b = x, y
            if best:
                out.append((item_id, *best))
        return out


def _groups(benchmark: DataFrame, group_chars: int) -> tuple[int, Iterator[list[tuple[int | None, str]]]]:
    """The number of groups, and the items of each, normalised; each group is fetched by itself."""
    rows = benchmark.select(F.col("item_id").cast("long"), as_text(F.col("text").cast("string")).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // max(1, group_chars // 2)) or 1
    if n > 1:
        rows = materialize(rows.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark")

    def each():
        for g in range(n):
            mine = rows.where(F.col("g") == g) if n > 1 else rows
            items = [(r.item_id, normalise(r.text)) for r in mine.orderBy("item_id", "text").toLocalIterator()]
            yield [x for x in items if x[1]]

    return n, each()


def _matches(rows: DataFrame, benchmark: DataFrame, rate: float, group_chars: int) -> DataFrame:
    """The first column, item_id, distance, end_char for rows of two columns, the second one the text."""
    first = rows.schema[0]
    schema = f"{first.name} {first.dataType.simpleString()}, item_id long, distance int, end_char long"
    n, groups = _groups(benchmark, group_chars)
    parts = []
    for items in groups:
        held = rows.sparkSession.sparkContext.broadcast(items)

        def make(held=held):
            match = Matcher(held.value, rate) if held.value else None
            return lambda part: [(k, *x) for k, t in part if match for x in match(normalise(t))]

        part = map_rows(rows.where("text is not null"), make, schema)
        if n > 1:
            part = materialize(part, "matches", keep=True)
            held.unpersist()
        parts.append(part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """doc_id, item_id, distance, end_char (in the normalised text) for each document and item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        return _matches(rows, benchmark, rate, group_chars)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """docs less the documents that hold a benchmark item. Rows are told apart by 128 bits of id and text: each is judged
    by its own text."""
    text = F.col("row.text").cast("string")
    keyed = packed(docs).withColumn("key", row_key(F.col("row.doc_id"), text))
    with scratch(docs.sparkSession):
        found = _matches(keyed.select("key", text.alias("text")), benchmark, rate, group_chars)
        held = materialize(found.select("key").distinct(), "leaks", keep=True)
    return only(keyed, held, "key", "left_anti").select(*unpacked(docs.columns))
