"""Toxicity: the gradient against differences, scores against plain loops, odd rows and names, the registered query."""

import math
import zlib

import numpy as np
import pytest

from treeledger.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240):
    r = np.random.default_rng(2)
    words = [a + b for a in "bcdfgl" for b in ("ara", "eno", "ilu", "oto")]
    rows, y = [], []
    for i in range(n):
        w = list(r.choice(words, 30 + 90 * (i % 5 == 0)))
        if i % 4 == 0:
            w[int(r.integers(0, len(w)))] = f"zork{r.choice(words)}"
        rows.append((i, " ".join(w)))
        y.append(int(i % 4 == 0))
    return rows, np.array(y)


@pytest.fixture(scope="module")
def model():
    rows, y = corpus()
    return toxicity.train([t for _, t in rows], y, float(y.mean()))


def test_pieces_equal_a_plain_version():
    words = [b"a", b"abc", "häß".encode(), b"longer-word", b"abc"]
    got = list(zip(*(x.tolist() for x in toxicity.pieces(words)), strict=True))
    want = []
    for k, w in enumerate(words):
        e = b"^" + w + b"$"
        want += [(int.from_bytes(e[i : i + n], "little") + (n << 40), k) for n in (4, 5) for i in range(len(e) - n + 1)]
    assert sorted(got) == sorted(want) and [k for _, k in got] == sorted(k for _, k in got)
    assert len(toxicity.pieces([])[0]) == 0


def plain_logit(net, x):
    """One window's logit, a number at a time. x: (words, inputs)."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = [[None] * len(x), [None] * len(x)]
    for k in (0, 1):
        s = np.zeros(h)
        for t in range(len(x)) if k == 0 else range(len(x) - 1, -1, -1):
            g, u = x[t] @ p["wx"][k] + p["b"][k], s @ p["u"][k]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            s = states[k][t] = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * s
    both = np.array([np.concatenate([a, b]) for a, b in zip(*states, strict=True)]).reshape(len(x), 2 * h)
    e = np.exp(np.tanh(both @ p["wa"]) @ p["va"])
    return float(((e / e.sum()) @ both if len(x) else np.zeros(2 * h)) @ p["wo"] + p["bo"][0])


def test_scores_equal_plain_windows(model):
    scorer, v = toxicity.Scorer(model), model["vectors"]
    r = np.random.default_rng(7)
    texts = [t for _, t in corpus(30)[0]] + ["", "unknown words only", " ".join(r.choice(["zorkara", "lara", "x!", "É"], 300))]
    for text, got in zip(texts, scorer(texts), strict=True):
        x = []
        for w in toxicity.tokens(text):
            e = b"^" + w + b"$"
            keys = [int.from_bytes(e[i : i + n], "little") + (n << 40) for n in (4, 5) for i in range(len(e) - n + 1)]
            rows = [v.piece_vectors[list(v.pieces).index(k)] for k in keys if k in v.pieces]
            x.append(np.concatenate([v.word_vectors[v.words.get(w, 0)], np.max(rows, axis=0) if rows else np.zeros(toxicity.VECTOR)]))
        n = len(x)
        starts = [0] if n <= toxicity.WINDOW else sorted({min(s, n - toxicity.WINDOW) for s in range(0, n, toxicity.STRIDE)})
        want = max(plain_logit(scorer.net, np.array(x[s : s + toxicity.WINDOW]).reshape(-1, 2 * toxicity.VECTOR)) for s in starts)
        assert got == pytest.approx(want, abs=2e-3)


def test_gradient_equals_differences():
    net, r = toxicity.Network(3), np.random.default_rng(3)
    inputs = r.normal(0, 0.5, (9, 2 * toxicity.VECTOR)).astype(np.float32)
    ids, lengths = r.integers(0, 9, (4, toxicity.WINDOW)), np.array([64, 5, 30, 64])
    out = r.normal(0, 1, 4).astype(np.float32)
    loss = lambda: float(net.forward(net.project(inputs), ids, lengths) @ out)
    _, kept = net.forward(net.project(inputs), ids, lengths, keep=True)
    gradient, d_inputs = net.gradient(kept, inputs, ids, out)
    for name, array, found in [*((k, net.p[k], gradient[k]) for k in net.p), ("inputs", inputs, d_inputs)]:
        for at in r.choice(array.size, min(6, array.size), replace=False):
            flat, held = array.reshape(-1), array.reshape(-1)[at]
            flat[at] = held + 0.01
            up = loss()
            flat[at] = held - 0.01
            down = loss()
            flat[at] = held
            assert found.reshape(-1)[at] == pytest.approx((up - down) / 0.02, abs=0.02, rel=0.05), name


def test_learned_from_few_texts(model):
    rows, y = corpus(400)
    z = toxicity.Scorer(model)([t for _, t in rows[240:]]) * model["curve"][0] + model["curve"][1]
    assert np.mean((z >= 0) == (y[240:] == 1)) > 0.95
    unseen = toxicity.Scorer(model)(["bara zorkination bara ceno", "bara nation bara ceno"])
    assert unseen[0] > unseen[1]


def test_keep_clean_with_clashing_names_and_shared_ids(spark, model):
    names = ["key", "score", "row", "doc", "_key"]
    rows = [(1, "bara zorkara bara"), (1, "bara ceno bara"), (None, "bara zorkara bara"), (None, "ceno"), (2, None), (3, ""), (4, "bara " * 100_000 + "zorkara")]
    docs = spark.createDataFrame([(d, t, *names) for d, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = toxicity.keep_clean(docs, model)
    assert out.columns == docs.columns
    assert sorted(((x.doc_id or -1), x.text or "", x["key"]) for x in out.collect()) == [(-1, "ceno", "key"), (1, "bara ceno bara", "key"), (2, "", "key"), (3, "", "key")]
    assert toxicity.keep_clean(docs.where("false"), model).count() == 0


def test_registered_query(spark, tmp_path):
    rows, y = corpus()
    docs = [(i, t, "en", "s", 0) for i, t in rows] + [(1000, None, None, None, None), (None, "", "en", "s", 0), (7, rows[7][1], "en", "s", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*((i, int(v)) for (i, _), v in zip(rows, y, strict=True)), (5, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) and not math.isnan(x.score) for x in got)
    assert all(x.held_out == (zlib.crc32(str("" if x.doc_id is None else x.doc_id).encode()) % 5 == 0) for x in got)
    scores = {x.doc_id: x.score for x in got}
    assert np.mean([(scores[i] >= 0.5) == (v == 1) for (i, _), v in zip(rows, y, strict=True)]) > 0.95
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert {x.score for x in queries.op8_toxicity(spark, str(tmp_path)).collect()} == {1.0}
