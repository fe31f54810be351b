"""Each stage of the corpus pipeline, and all of them, on a small fixture against plain Python."""

import numpy as np

import corpus_pipeline
from treeledger.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the evil queen and jack"


def fixture(spark, folder):
    r = np.random.default_rng(3)
    words = [a + b for a in "bcdfgl" for b in ("ara", "eno", "ilu", "oto")]
    rows, labels = [], []
    for i in range(120):
        w = list(r.choice(words, 40))
        if i % 4 == 0:
            w[7] = "zorkish"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    copy = " ".join(r.choice(words, 40))
    rows += [(200, copy), (201, copy), (202, f"{' '.join(r.choice(words, 20))} {ITEM} tail"), (203, f"{' '.join(r.choice(words, 20))} a.b@mail.example.com end"), (204, None), (205, "")]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, *_ in rows}


def test_stages_and_run_equal_plain_python(spark, tmp_path):
    texts = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, want):
        nonlocal docs
        docs = corpus_pipeline.materialize(stages[name](spark, docs, str(tmp_path)), name)
        got = docs.select("doc_id", "text", "n_chars").collect()
        assert {x.doc_id: x.text for x in got} == want and len(got) == len(want)
        assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in got)
        return want

    kept = after("toxicity", {i: t for i, t in texts.items() if "zorkish" not in (t or "").split()})
    first = {}
    for i in sorted(kept):
        first.setdefault(kept[i] or "", i)
    kept = after("near_dedup", {i: t for i, t in kept.items() if first[t or ""] == i or not t})
    kept = after("decontaminate", {i: t for i, t in kept.items() if ITEM not in (t or "")})
    kept = after("pii", {i: t and t.replace("a.b@mail.example.com", "[EMAIL]") for i, t in kept.items()})
    want = {x.doc_id: x.taken for x in mixing.mix(docs).collect() if x.taken > 0}
    assert {x.doc_id: x.taken for x in stages["mixing"](spark, docs, str(tmp_path)).collect()} == want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.taken for x in out} == want and all(x.text == kept[x.doc_id] for x in out)
