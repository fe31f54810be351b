"""Near-duplicates: shared ids, odd names, long texts, empty tables; equality with all pairs is in test_operators."""

import random

from treeledger.llm import near_dedup, queries


def words(r, n):
    return " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))


def test_rows_that_share_an_id_are_one_document(spark):
    r = random.Random(1)
    a, b, c = words(r, 30), words(r, 30), words(r, 30)
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (8, c), (8, c), (9, None), (9, "")], "doc_id long, text string")
    got = {(x.doc_id, x.component_id, x.kept) for x in near_dedup.components(docs).collect()}
    assert got == {(1, 1, True), (5, 1, False), (7, 1, False), (8, 8, True), (9, 9, True)}
    assert sorted(x.doc_id for x in near_dedup.deduplicate(docs).collect()) == [1, 8, 9]


def test_clashing_names_long_texts_and_ties(spark):
    r = random.Random(2)
    long = words(r, 60_000)
    near = long.split(" ")
    near[100] = near[5000] = "other"
    names = ["set", "class", "k1", "k2", "comp", "component_id", "kept", "n_shingles", "bands", "count", "id"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(3, long), (2, " ".join(near)), (4, "x" * 1_000_000), (6, "x" * 1_000_000), (10, words(r, 40))]
    docs = spark.createDataFrame([(d, t, *names) for d, t in rows], schema)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x["class"]) for x in kept.collect()) == [(2, "class"), (4, "class"), (10, "class")]
    assert near_dedup.deduplicate(docs.where("false")).count() == 0


def test_registered_query(spark, tmp_path):
    rows = [(2, "one two three four five six", "a"), (1, "ONE two\tthree four five six", "b"), (3, None, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in queries.op3_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)}
