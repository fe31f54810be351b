"""HTML extraction: unclosed and broken markup, names of wrappers, linear time, the Spark job and its query."""

import time

import pytest

from treeledger.llm import html_extract, queries

ARTICLE = "<article><h1>A title</h1><p>First line here.</p><p>Second line.</p></article>"
WANT = "A title\n\nFirst line here.\n\nSecond line."


@pytest.fixture(scope="module")
def tree():
    return html_extract.tree_of_pages()


def test_elements_without_end_lose_no_article(tree):
    for start in ("<head><title>t</title>", "<body><button>Menu ", "<select><option>x ", "<textarea>x ", "<svg><g> ", "<title>x ", "<object> ", "<audio>", "<video>", "<noscript>"):
        assert html_extract.extract(start + ARTICLE, tree) == WANT
    assert html_extract.extract(f"<button>a{ARTICLE}<button>b</button>", tree) == WANT
    for whole in ("<button>a</button>", "<video><p>no video</p></video>", "<noscript><p>enable</p></noscript>", "<select><option>a<option>b</select>", "<svg><text>x</text></svg>"):
        assert html_extract.extract(f"{whole}{ARTICLE}{whole}", tree) == WANT


def test_names_count_as_whole_tokens(tree):
    for name in ("layout has-sidebar", "post comments-open", "no-ads", "with-header", "entry-header-off"):
        assert html_extract.extract(f'<div class="{name}">{ARTICLE}</div>', tree) == WANT
    for name in ("comment-list", "ad", "ad-slot-3 ad-box", "cookieNotice", "related-posts", "sidebar-left", "site-footer"):
        assert html_extract._named(name, False)
    for name in ("comments-open", "has-sidebar", "header-off", "adventure", "shareholder"):
        assert not html_extract._named(name, False)
    body = "<h1>A title</h1>" + "<p>" + "word " * 40 + "</p><p>" + "more " * 50 + "</p>"
    whole = html_extract.extract(f"<div>{body}</div><footer>x</footer>", tree)
    assert html_extract.extract(f'<div class="sidebar">{body}</div><footer>x</footer>', tree) == whole
    assert whole.count("word") == 40 and whole.count("more") == 50
    assert "buy" not in html_extract.extract(f'<div>{body}</div><div class="sidebar">{"buy " * 60}</div>', tree)


def test_broken_markup_takes_linear_time(tree):
    began = time.time()
    for w in ("<a " * 300_000, "<b>" * 100_000 + "</i>" * 100_000, '<a ">" ' * 100_000, "<!--" * 100_000, "<textarea>" * 100_000, "<button>" * 100_000,
              "<p>" * 200_000, "<b>" * 100_000 + "<div>x</div>" * 50_000, "<" * 300_000, "<div class='" * 100_000, "<b><p>" * 60_000):
        html_extract.extract(w, tree)
    assert time.time() - began < 30


def test_pages_of_any_kind_in_spark(spark, tmp_path):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (2, None, None, None), (3, "", "", ""), (None, "v", "no markup", "y"), (4, "w", "<article><p>" + "é" * 2_000_000, "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((x.page_id or -1, x.url or "", x.text, x.n_chars) for x in queries.op4_html_extract(spark, str(tmp_path)).collect()), key=lambda x: x[:2])
    assert [x[:2] for x in got] == [(-1, "v"), (1, "u"), (1, "u"), (2, ""), (3, ""), (4, "w")]
    assert [x[2] for x in got[1:5]] == [WANT, WANT, "", ""]
    assert all(len(t) == n for _, _, t, n in got) and got[5][3] == 2_000_000
    assert html_extract.main_text(spark.read.parquet(f"{tmp_path}/pages.parquet").where("false")).count() == 0


NAV, FOOT = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', "<footer>&copy; x</footer>"
LONG = " ".join(["word"] * 40)


def test_short_pages_and_lists_of_links_are_kept(tree):
    links = "<ul><li><a href=x>A first source</a></li><li><a href=y>Second</a></li></ul>"
    cases = {
        "<div><h1>Title</h1><p>One short line.</p></div>": "Title\n\nOne short line.",
        "<div><p>One short line of an article here.</p></div>": "One short line of an article here.",
        "<p>One.</p><p>Two words.</p>": "One.\n\nTwo words.",
        "<div class=ad>Buy this now</div><div><h1>T</h1><p>One.</p></div>": "T\n\nOne.",
        f"<article><h1>T</h1><p>{LONG}</p><h2>Sources</h2>{links}</article>": f"T\n\n{LONG}\n\nSources\n\nA first source\n\nSecond",
        f"<article><h1>T head</h1><p>{LONG}</p>{links}</article>": f"T head\n\n{LONG}",
        f"<div><h1>T</h1><p>{LONG}</p></div><div class='related-stories'><p>Another tale of {LONG}</p></div>": f"T\n\n{LONG}",
        f"<div class='share'><article><h1>T head</h1><p>{LONG}</p></article></div>": f"T head\n\n{LONG}",
        f"<div class='share'><h1>T head</h1><p>{LONG}</p></div>": f"T head\n\n{LONG}",
    }
    for page, want in cases.items():
        assert html_extract.extract(NAV + page + FOOT, tree) == want, page


def test_labelled_pages_left_out_are_judged_by_the_others():
    """Each labelled page by a tree that hasn't seen it: the share of blocks judged right."""
    right = total = 0
    pages = list(html_extract.LABELLED_PAGES)
    for k, page in enumerate(pages):
        html_extract.LABELLED_PAGES[:] = pages[:k] + pages[k + 1 :]
        try:
            table = html_extract.labelled()
            html_extract.LABELLED_PAGES[:] = [page]
            own = html_extract.labelled()[len(html_extract.LABELLED) :]
        finally:
            html_extract.LABELLED_PAGES[:] = pages
        tree = html_extract.grow(table[:, :-1], table[:, -1], depth=12)
        right += sum(html_extract.decide(tree, r[:-1]) == r[-1] for r in own)
        total += len(own)
    print(f"blocks of left-out pages: {right} of {total}")
    assert right / total >= 0.95
