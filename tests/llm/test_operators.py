"""Small cases of the training-data operators against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.llm import chat_format, decontaminate, html_extract, language_id, mixing, near_dedup, quality, toxicity, va_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_myers_equals_the_plain_distance():
    r = np.random.default_rng(1)
    for _ in range(100):
        p = "".join(r.choice(list("ab c"), r.integers(1, 70)))
        t = "".join(r.choice(list("ab c"), r.integers(0, 90)))
        assert decontaminate.myers(p, t) == brute_distance(p, t)


def test_decontaminate_drops_leaks_with_edits_and_keeps_the_rest(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack"
    docs = spark.createDataFrame([
        (1, f"before {item.upper()} after", None, None, None), (2, item.replace("wizards", "wizard"), None, None, None),
        (3, "nothing to see here", None, None, None), (4, None, None, None, None), (5, "", None, None, None), (None, item, None, None, None),
    ], DOCS)
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None)], "item_id long, text string")
    found = {(r.doc_id, r.distance) for r in decontaminate.matches(docs, bench).collect()}
    assert found == {(1, 0), (2, 1), (None, 0)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 6


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: (len(sets[d]), comp[d]) for d in sets}


def test_near_dedup_equals_all_pairs(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = list(r.choice(words, 120))
    rows, text = [(0, " ".join(base)), (1, None), (2, "  "), (3, "one two"), (4, "ONE two"), (5, " ".join(base))], list(base)
    for i in range(6, 40):  # a chain of copies that drift apart
        text[int(r.integers(0, 120))] = str(r.choice(words))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, "no id", "y")], "doc_id long, text string, set string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.components(docs).collect()}
    assert got.pop(None) == (1, None)
    assert got == plain_components(rows)
    kept = [x.doc_id for x in near_dedup.deduplicate(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for _, c in got.values()})
    assert near_dedup.components(docs.where("false")).count() == 0


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.normal(0, 0.2, (120, 8))
    v[7] = v[3] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(120)] + [(200, None), (201, [float("nan")] * 8), (202, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in va_search.top_k(df, F.col("vec_id") % 50 == 0).collect())
    w = np.floor(256 * v).astype(int)
    want = []
    for q in range(0, 120, 50):
        best = sorted((-int(w[q] @ w[i]), i) for i in range(120) if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == want


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok\\b\\h#### x </turn"
    rows = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", None), (3, None, None, "x"), (3, 1, "user: ", "y")], "conv_id long, turn long, role string, text string")
    out = {x.conv_id: x for x in chat_format.parse_chats(chat_format.format_chats(rows)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", said), ("assistant", said)]
    assert out[1].valid and out[1].loss_text == said and not out[2].valid and out[2].loss_text == ""
    assert [(t.role, t.text) for t in out[3].turns] == [("", "x"), ("user: ", "y")]
    assert "".join(s.text for s in out[1].segments) == out[1].formatted


def test_mixing_meets_targets(spark):
    r = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), "en", f"s{min(i % 7, 3)}" if i % 11 else None, 0) for i in range(900)]
    docs = spark.createDataFrame([*rows, (None, None, None, "s0", None)], DOCS)
    out = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", F.size("shards").alias("n")).collect()
    assert len(out) == 901 and all(x.taken <= 3 * x.size and x.taken == x.n * x["size"] for x in out)
    total = sum(x["size"] for x in out)
    taken, target = {}, {}
    for x in out:
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    again = mixing.mix(docs).select("doc_id", "taken").collect()
    assert sorted(((x.doc_id or -1), x.taken) for x in out) == sorted(((x.doc_id or -1), x.taken) for x in again)
    assert mixing.mix(docs.where("false")).count() == 0


def test_main_text():
    tree = html_extract.grow(html_extract.LABELLED[:, :-1], html_extract.LABELLED[:, -1])
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <div class="ad">Buy now</div><article><h1>A &amp; B</h1><p><b>First &lt;1&gt;<br> line.<p>Be.</p><aside>more</aside>
    <div class="comments"><p>nice text here</p></div></article><footer>&copy; x</footer></body></html>"""
    assert html_extract.extract(page, tree) == "A & B\n\nFirst <1> line.\n\nBe."
    assert html_extract.extract("", tree) == ""
    labels = [html_extract.decide(tree, x[:-1]) for x in html_extract.LABELLED]
    assert np.mean(np.array(labels) == html_extract.LABELLED[:, -1]) > 0.95


def test_raw_elements_and_open_heads():
    tree = html_extract.grow(html_extract.LABELLED[:, :-1], html_extract.LABELLED[:, -1])
    article = "<article><h1>A title</h1><p>First line.</p><p>Second line.</p></article>"
    for raw in ("<script>for(i=0;i<n;i++){f('x')}</script>", "<SCRIPT>if(a<b)c='<p>'</Script >", "<style>a<b{}</style>",
                "<textarea><b 'x</textarea>", "<title>a <b</title>", "<script src=x></script>", "<svg><title/><style>a<b{}</style></svg>"):
        page = f"<html><head><meta charset=utf-8>{raw}</head><body>{raw}{article}{raw}</body></html>"
        assert html_extract.extract(page, tree) == "A title\n\nFirst line.\n\nSecond line."
    for page in (f"<head><title>t</title><body>{article}", f"<html><head><meta a=b><title>t</title>{article}</html>"):
        assert html_extract.extract(page, tree) == "A title\n\nFirst line.\n\nSecond line."
    assert html_extract.extract(f"{article}<script>a<b", tree) == "A title\n\nFirst line.\n\nSecond line."


def test_names_of_wrappers_and_headers():
    tree = html_extract.grow(html_extract.LABELLED[:, :-1], html_extract.LABELLED[:, -1])
    body, want = "<h1>A title</h1><p>First line.</p><p>Second line.</p>", "A title\n\nFirst line.\n\nSecond line."
    for name in ("page has-sidebar", "no-ads", "layout side-by-side", "sidebar", "withSidebar"):
        assert html_extract.extract(f'<body><div class="{name}"><article>{body}</article></div>', tree) == want
    for name in ("entry-header", "post-header", "header"):
        assert html_extract.extract(f'<article><div class="{name}"><h1>A title</h1></div><p>First line.</p><p>Second line.</p></article>', tree) == want
    teaser = '<div class="related"><article><p>Another one.</p></article></div><div class="comments"><article><p>Nice one.</p></article></div>'
    assert html_extract.extract(f"<article>{body}</article>{teaser}", tree) == want
    assert html_extract.extract(f'<article>{body}<div class="comments"><p>Nice one.</p></div></article>', tree) == want
    long = " ".join(["word"] * 180)
    for link, kept in ((f"<p>{long}</p>", True), (f"<p><a href=x>{long}</a></p>", False)):
        assert (long in html_extract.extract(f'<article>{body}<div class="share">{link}</div></article>', tree)) == kept
    assert long not in html_extract.extract(f"<article>{body}<aside>{long}</aside><p hidden>{long}</p></article>", tree)
    assert long not in html_extract.extract(f'<article>{body}</article><div class="comments"><p>{long}</p></div>', tree)


def test_language_of_pages(spark):
    text = {"en": "the cat and the dog with that thing", "de": "der hund und die katze nicht mit schule", "fr": "le chien et la maison que nous avons"}
    docs = spark.createDataFrame([(i, t, l, "s", 0) for i in range(4) for l, t in text.items()], DOCS)
    rows = [(i, f"https://a.example.{l}/x", f"<html lang='{l}'><p>{t}</p></html>") for i, (l, t) in enumerate(text.items())]
    pages = spark.createDataFrame([*rows, (9, None, None)], "page_id long, url string, html string")
    got = {x.page_id: x for x in language_id.identify(pages, docs).collect()}
    assert [got[i].lang for i in range(3)] == list(text) and got[9].lang in text
    assert all(0 <= x.probability <= 1 for x in got.values())


def test_classifiers_learn(spark):
    r = np.random.default_rng(2)
    words = [a + b for a in "bcdfgl" for b in ("ara", "eno", "ilu", "oto")]
    rows, labels = [], []
    for i in range(240):
        w = list(r.choice(words, 40))
        bad, rude = i % 3 == 0, i % 4 == 0
        if rude:
            w[7] = f"zork{r.choice(words)}"
        t = " ".join(w)
        rows.append((i, "### ".join(t.upper().split()) if bad else t, "en", "s", 0))
        labels.append((i, int(not bad), int(rude)))
    docs = spark.createDataFrame([*rows, (1000, "", "en", "s", 0), (1001, None, None, None, None)], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    q = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, lab)).collect()}
    t = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    assert len(q) == len(t) == 242 and all(0 <= x <= 1 for x in [*q.values(), *t.values()])
    assert np.mean([(q[i] >= 0.3) == bool(y) for i, y, _ in labels]) > 0.95
    assert np.mean([(t[i] >= 0.5) == bool(y) for i, _, y in labels]) > 0.95
    none = toxicity.fit(docs, lab.where("false"))
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0}
