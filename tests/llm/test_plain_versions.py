"""Language identification and quality scores against plain Python over the same rows."""

import math
import re
import random
from collections import Counter, defaultdict

import pytest
import zstandard

from treeledger.llm import language_id, quality

WORDS = {"en": "the house and river with water over stone", "de": "das haus und der fluss mit wasser über stein", "fr": "la maison et le fleuve avec eau sur pierre"}
DOCS = "doc_id long, text string, lang string"
PAGES = "page_id long, url string, html string"


def sentence(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


def plain_languages(pages, docs):
    """{page_id: (lang, probability, text_lang)} with dictionaries and loops only."""
    counts = defaultdict(Counter)
    for _, text, lang in docs:
        if lang is not None and text is not None:
            counts[lang].update(language_id.trigrams(text).tolist())
    langs = sorted(counts)
    whole = {x: sum(counts[x].values()) + language_id.SMOOTH * language_id.BUCKETS for x in langs}
    rows = []
    for page_id, url, html in pages:
        t = language_id.trigrams(language_id.visible(html or "")).tolist()
        weight = min(1.0, language_id.TEXT_TRIGRAMS / max(1, len(t)))
        text = [weight * sum(math.log((counts[x][b] + language_id.SMOOTH) / whole[x]) for b in t) for x in langs]
        soft = [math.exp(v - max(text)) for v in text]
        found = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", html or "")
        host, domain, suffix = language_id.address(url)
        keys = {"declared": found[1].lower() if found else "", "suffix": suffix, "domain": domain, "host": host}
        rows.append((page_id, text, [v / sum(soft) for v in soft], keys))
    out = {}
    for page_id, text, own, keys in rows:
        everyone = [sum(soft[i] for _, _, soft, _ in rows) for i in range(len(langs))]
        top = [(v + 1) / (sum(everyone) + len(langs)) for v in everyone]

        def share(kind, i, prior):
            same = [soft for _, _, soft, k in rows if k[kind] == keys[kind]]
            return (sum(s[i] for s in same) - own[i] + language_id.KAPPA * prior) / (len(same) - 1 + language_id.KAPPA)

        score = []
        for i in range(len(langs)):
            host = share("host", i, share("domain", i, top[i]))
            score.append(text[i] + sum(math.log(share(kind, i, top[i]) / top[i]) for kind in ("declared", "suffix")) + math.log(max(host, 1e-12)))
        mass = sum(math.exp(v - max(score)) for v in score)
        out[page_id] = (langs[score.index(max(score))], 1 / mass, langs[text.index(max(text))])
    return out


def test_fused_languages_equal_the_plain_version(spark):
    rnd = random.Random(7)
    docs = [(i, sentence(rnd, lang, 30), lang) for i, lang in enumerate(list(WORDS) * 5)]
    docs += [(90, None, "en"), (91, "word", None), (92, "", "de")]
    pages = []
    for i in range(40):
        lang = rnd.choice(list(WORDS))
        tag = rnd.choice(["", f' lang="{lang}"', ' lang="en-GB"'])
        url = rnd.choice([f"https://www.site{i % 3}.{lang}/p/{i}", f"http://user@hub.example.com:80/{i}", "odd address", None])
        pages.append((i, url, rnd.choice([None, "", f"<html{tag}><script>the the the</script><p>{sentence(rnd, lang, rnd.choice([1, 4, 200]))}</p></html>"])))
    got = language_id.identify(spark.createDataFrame(pages, PAGES), spark.createDataFrame(docs, DOCS)).collect()
    want = plain_languages(pages, docs)
    assert len(got) == len(pages)
    for r in got:
        lang, probability, text_lang = want[r.page_id]
        assert r.probability == pytest.approx(probability, rel=1e-4)
        if probability > 0.5001:  # a tie of rounding aside
            assert r.lang == lang
        if pages[r.page_id][2]:
            assert r.text_lang == text_lang


def test_languages_without_pages_or_labelled_documents(spark):
    docs = spark.createDataFrame([(1, sentence(random.Random(1), "en", 9), "en")], DOCS)
    assert language_id.identify(spark.createDataFrame([], PAGES), docs).count() == 0
    page = spark.createDataFrame([(1, None, "<p>the house</p>"), (1, None, "<p>the house</p>")], PAGES)
    none = language_id.identify(page, spark.createDataFrame([], DOCS)).collect()
    assert [(r.page_id, r.lang, r.probability) for r in none] == [(1, None, 0.0)] * 2


def plain_quality(text, model):
    raw = (text or "").encode()
    parts = [raw[at : at + quality.CHUNK] for at in range(0, len(raw), quality.CHUNK)] or [b""]
    sizes = {}
    for side in ("good", "bad"):
        dictionary = zstandard.ZstdCompressionDict(model[side])
        z = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes[side] = [len(z.compress(p)) for p in parts]
    g, b = sum(sizes["good"]), sum(sizes["bad"])
    d, ratio = (b - g) / (b + g), math.log(g / (len(raw) + 1))
    least = min((y - x) / (y + x) for x, y in zip(sizes["good"], sizes["bad"], strict=True))
    x = [d, ratio, least, d * d, ratio * ratio, d * ratio]
    z = model["w"][-1] + sum(w * (v - m) / s for w, v, m, s in zip(model["w"], x, model["mean"], model["sd"], strict=False))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_equals_the_plain_version(spark):
    rnd = random.Random(3)
    rows = [(i, sentence(rnd, "en" if i % 2 else "de", rnd.choice([3, 40, 400])), None) for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert "constant" not in model
    odd = [(100, None, None), (101, "", None), (102, "über " * 40_000, None), (None, "the house", None), (101, "", None)]
    got = quality.score(spark.createDataFrame(rows + odd, DOCS), model).collect()
    want = sorted((-1 if d is None else d, plain_quality(text, model)) for d, text, _ in rows + odd)
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got)
    assert [d for d, _ in found] == [d for d, _ in want]
    assert [v for _, v in found] == pytest.approx([v for _, v in want], rel=1e-9)


def test_quality_of_one_class_is_its_share(spark):
    docs = spark.createDataFrame([(i, "the house", None) for i in range(20)], DOCS)
    one = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert one == {"constant": 1.0}
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.score(spark.createDataFrame([], DOCS), one).count() == 0
