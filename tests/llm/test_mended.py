"""Concurrent operators, mixes of repeated rows, and pages that are never closed."""

import re
import time
from concurrent.futures import ThreadPoolExecutor
from html import unescape

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeledger.llm import common, language_id, mixing, near_dedup, va_search


def test_operators_in_threads_leave_each_other_alone(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 31 + k) % 97}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [((i * 37 + k * 11) % 29) / 29 for k in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")
    near = lambda: sorted(map(tuple, near_dedup.components(docs).select("doc_id", "component_id").collect()))
    top = lambda: sorted(map(tuple, va_search.top_k(vectors, F.col("vec_id") % 10 == 0, k=3).collect()))
    want = [near(), top()]
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda f: f(), [near, top, near, top]))
    assert got == want * 2


def test_scratch_blocks_are_a_threads_own(spark):
    df = spark.range(3)
    with common.scratch(spark):
        outer = common.materialize(df, "outer")
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(lambda: common.materialize(df, "other")).result()  # under no block of its own thread
        with common.scratch(spark):
            kept = common.materialize(df, "kept", keep=True)
        assert kept.count() == outer.count() == 3
    assert other.count() == 3


def near_target(rows):
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine), source
        assert all(r.taken <= 3 * r.size for r in mine)


def test_equal_rows_are_taken_by_copies(spark):
    ten = " ".join("abcdefghij")
    cases = [
        [(1, ten, "a")] * 1000 + [(i, f"{ten[:-1]} {i}", "b") for i in range(2, 1002)],
        [(None, ten, "a")] * 300 + [(None, "x y", "a")] * 70 + [(i, ten, "b") for i in range(500)] + [(None, None, "c")] * 5,
        [(i % 3, ten, None) for i in range(400)] + [(7, ten, "a")] * 100 + [(8, ten, "b")] * 100,
    ]
    for rows in cases:
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
        first = mixing.mix(docs).collect()
        assert len(first) == len(rows)
        near_target(first)
        again = mixing.mix(docs).collect()
        key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
        assert sorted(map(key, first)) == sorted(map(key, again))


OLD_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
OLD_LANG = re.compile(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""")
PIECES = ["<script", "</script >", "<STYLE>", "</style>", "<!--", "-->", "<!-->", "<", ">", "</scripts>", "<html ", "lang", "=", "'en", "x-lang=de ", " ", "a", "&amp;", "<template>", "</template"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_linear_readers_read_as_the_patterns_do(pieces):
    page = "".join(pieces)
    assert language_id.visible(page) == unescape(re.sub(r"<[^>]*>", " ", OLD_HIDDEN.sub(" ", page)))
    m = OLD_LANG.search(page)
    assert language_id.declared(page) == (m[1].lower() if m else "")


def test_broken_pages_take_linear_time():
    for piece in ("<html ", "<!--", "<script", "<style>", "<", "<html lang ", "</script", "<script></script "):
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        language_id.visible(page)
        language_id.declared(page)
        assert time.process_time() - began < 5, piece
