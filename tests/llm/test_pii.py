"""Personal data: the readers against plain patterns, the graph against a plain version, odd rows and names."""

import math
import random
import re
import time

from treeledger.llm import pii, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_base_spans_and_redaction(spark):
    text = "é a.b+c@mail.example.com 10.0.0.256 1.2.3.4.5 card 4111 1111-1111 1111 tel +1 (269) 555-3296 x@y"
    names = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert names == [("email", "a.b+c@mail.example.com"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (269) 555-3296")]
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, None, None, None, None), (3, "", "", "", 0)], DOCS)
    out = pii.redact(docs).collect()
    assert len(out) == 4
    assert [x.text for x in out if x.doc_id == 1] == ["é [EMAIL] 10.0.0.256 [IP].5 card [CARD] tel [PHONE] x@y"] * 2


def test_patterns_discover_unseen_numbers(spark):
    rows = [(i, f"words here customer hotline +49 30 5550{i:04d} today", "de", "s", 0) for i in range(40)]
    rows += [(100, "words here customer hotline 030 5551234 today", "de", "s", 0), (101, "number 030 9998887 alone", "de", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: len(x.spans) for x in pii.annotate(docs).collect()}
    assert got[0] == 1 and got[100] == 1 and got[101] == 0


def test_discovered_numbers_qualify_patterns_without_seeds(spark):
    """Two hops: hotline (seeds) vouches for four numbers, these for 'reach desk', and that for a number seen only there."""
    rows = [(i, f"words here customer hotline +49 30 5550{i:04d} today", "de", "s", 0) for i in range(40)]
    near = [f"030 555123{i}" for i in range(4)]
    rows += [(100 + i, f"words here customer hotline {x} today", "de", "s", 0) for i, x in enumerate(near)]
    rows += [(200 + i, f"please reach desk {x} soon", "de", "s", 0) for i, x in enumerate([*near, "040 7776661"])]
    rows += [(300 + i, f"order number {x} shipped", "de", "s", 0) for i, x in enumerate([*near, "040 1112223"])]
    rows += [(400 + i, f"order number {w} shipped", "de", "s", 0) for i, w in enumerate("one two three four five six".split())]
    docs = spark.createDataFrame([*rows, (500, None, None, None, None)], DOCS)
    got = {x.doc_id: len(x.spans) for x in pii.annotate(docs).collect()}
    assert [got[100 + i] for i in range(4)] == [1] * 4
    assert [got[200 + i] for i in range(5)] == [1] * 5
    assert [got[300 + i] for i in range(5)] == [0] * 5
    assert got[500] == 0 and all(got[400 + i] == 0 for i in range(6))


def test_undecided_candidates_do_not_count_against_a_pattern(spark):
    rows = [(i, f"words here customer hotline +49 30 5550{i:04d} today", "de", "s", 0) for i in range(4)]
    rows += [(100 + i, f"words here customer hotline 030 555{i:04d} today", "de", "s", 0) for i in range(30)]
    got = {x.doc_id: len(x.spans) for x in pii.annotate(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[100 + i] == 1 for i in range(30))


def test_readers_equal_plain_patterns():
    """The base patterns as written in the contract, over strings that try their edges."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    like = re.compile(r"[^\s@,;:<>()\"']+@[^\s@,;:<>()\"']+")
    r = random.Random(1)
    for n in range(20000):
        t = "".join(r.choice("a1.@@ -+,25" if n % 2 else "0123456789012345 -+.") for _ in range(r.randint(0, 40)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == sorted(want)
        assert [x for x in pii.candidates(t, []) if x[1] == 0] == [(m.start(), 0, m.end()) for m in like.finditer(t)]


def test_long_texts_take_linear_time():
    began = time.time()
    for t in (",".join(f"u{i}@mail.example.com" for i in range(20000)), "a" * 500_000 + "1", "1" * 500_000, "@" * 100_000, "1.2." * 100_000, "+1 " * 100_000, "(" * 300_000 + "+1" + "(" * 300_000):
        pii.candidates(t, pii.base_spans(t))
    assert time.time() - began < 20


def plain_words(t):
    return [(m.start(), m.end(), "0" if re.search("[0-9]", m.group()) else m.group().lower()) for m in re.finditer(r"\w+", t)]


def plain_graph(texts, support=3, trust=0.9):
    """The extraction over a list of texts, in plain Python: (text, start, end, kind) of what the graph adds."""
    edges, words, others = {}, {}, {}
    occ = []
    for d, t in enumerate(texts):
        spans = pii.base_spans(t) + pii.secret_seeds(t)
        found = [(a, b, k, pii._FORM[k]) for a, k, b in spans] + [(a, b, None, f) for a, f, b in pii.candidates(t, spans)]
        w = plain_words(t)
        taken = set()
        seq = ["^", "^", *[x[2] for x in w], "$", "$"]
        around = lambda i, j: [("b", seq[i + 1]), ("bb", seq[i], seq[i + 1]), ("ba", seq[i + 1], seq[j + 2]), ("aa", seq[j + 2], seq[j + 3])]
        for a, b, k, f in found:
            i = len([x for x in w if x[1] <= a])
            j = len([x for x in w if x[0] < b])
            taken |= set(range(i, j))
            for c in around(i, j):
                occ.append((d, a, b, k, f, t[a:b].lower(), c))
                others[c, f] = others.get((c, f), 0) + 1
        for i in range(len(w)):
            if i not in taken:
                for c in around(i, i + 1):
                    words[c] = words.get(c, 0) + 1
    for d, a, b, k, f, inst, c in occ:
        edges.setdefault((f, c), []).append((inst, k))
    trusted = {(inst, k): 1.0 for es in edges.values() for inst, k in es if k is not None}
    distrusted = set()
    while True:
        conf, known = {}, {i for i, _ in trusted}
        for (f, c), es in edges.items():
            no = words.get(c, 0) + sum(n for (c2, f2), n in others.items() if c2 == c and f2 != f)
            for kind in range(5):
                good = [(i, trusted[i, kind]) for i, k in es if (i, kind) in trusted and k in (None, kind)]
                if len({i for i, _ in good}) < support or all(k is not None for _, k in es):
                    continue
                bad = sum(1 for i, k in es if k is None and i not in known and (i, kind) in distrusted)
                conf[f, c, kind] = sum(s for _, s in good) / (sum(1 for i, _ in es if i in known) + no + bad)
        score = {}
        for (f, c, kind), p in conf.items():
            for i, k in edges[f, c]:
                if k is None:
                    score.setdefault((i, kind), {})[f, c] = (p, sum(1 for i2, k2 in edges[f, c] if i2 == i and k2 is None) and 1)
        distrusted, new = set(), dict(trusted)
        for at, by in score.items():
            s = 1 - math.exp(sum(math.log(1 - min(p, 0.999)) for p, _ in by.values() if p >= trust))
            if s >= trust:
                new[at] = max(new.get(at, 0), s)
            if 1 - math.exp(sum(math.log(1 - min(p, 0.999)) for p, _ in by.values())) <= 1 - trust:
                distrusted.add(at)
        if len(new) == len(trusted):
            break
        trusted = new
    best = {}
    for d, a, b, k, f, inst, c in occ:
        for kind in range(5):
            p = conf.get((f, c, kind), 0)
            if k is None and p >= trust and (inst, kind) in new:
                best[d, a, b] = max(best.get((d, a, b), (0, 0)), (p, -kind))
    return {(d, a, b, -k) for (d, a, b), (_, k) in best.items()}


def test_graph_equals_a_plain_version(spark):
    r = random.Random(4)
    texts = []
    heads = ["customer hotline", "reach desk", "order number", "call me", "write to"]
    for n in range(160):
        number = f"030 55{r.randint(0, 30):05d}"
        things = [f"+49 30 5550{r.randint(0, 20):04d}", number, f"a{r.randint(0, 9)}@host", f"a{r.randint(0, 9)}@mail.example.com", "nothing"]
        head = r.choice(heads)
        weights = {"customer hotline": [6, 6, 0, 0, 0], "reach desk": [1, 9, 0, 0, 0], "order number": [0, 5, 0, 0, 5], "call me": [3, 3, 1, 1, 1], "write to": [0, 0, 4, 7, 0]}[head]
        texts.append(f"x{n} {head} {r.choices(things, weights)[0]} {r.choice(['now', 'today', 'then'])} y")
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {(x.doc_id, s.start, s.end, s.kind) for x in pii.annotate(docs).collect() for s in x.spans if s not in x.base}
    want = plain_graph(texts)
    assert want and got == want


def test_secrets_of_other_forms_are_discovered(spark):
    rows = [(i, f'words token = "{i:040x}" {"abcdefghij"[i]} words', "en", "s", 0) for i in range(1, 9)]
    rows += [(20, 'WORDS TOKEN = "0123456789ABCDEF0123456789ABCDEF01234567"!! HERE', "en", "s", 0), (21, "plain ABCDEF0123456789ABCDEF0123 here", "en", "s", 0)]
    got = {x.doc_id: [(pii.NAMES[s.kind], s.start) for s in x.spans] for x in pii.annotate(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == [("secret", 15)] and got[20] == [("secret", 15)] and got[21] == []


def test_clashing_columns_and_odd_tables(spark):
    wide = "doc_id long, text string, key string, spans string, `row` string, maybe string, base string, occ string, `a.b` string, start int"
    docs = spark.createDataFrame([(1, "mail a.b@mail.example.com now", *"klmnopq", 7), (None, "mail a.b@mail.example.com now", *"klmnopq", 7), (1, "other 1.2.3.4", *"klmnopq", 7), (1, None, *"klmnopq", 7)], wide)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((x.text or "", x.key, x["a.b"], x.start) for x in out.collect()) == [("", "k", "q", 7), *[("mail [EMAIL] now", "k", "q", 7)] * 2, ("other [IP]", "k", "q", 7)]
    assert pii.annotate(docs.where("false")).count() == 0 and pii.redact(docs.where("false")).count() == 0


def test_registered_query(spark, tmp_path):
    spark.createDataFrame([(1, "a.b@mail.example.com 1.2.3.4", "en", "s", 0), (2, None, None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op6_pii(spark, str(tmp_path)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_spans, got[1].spans) == (1, 1, 0, 2, "email:0:20,ip:21:28")
    assert got[2].spans == "" and got[2].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
