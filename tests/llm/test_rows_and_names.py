"""Odd rows and clashing names of vector search, decontamination and mixing, and plain versions of their results."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treeledger.llm import decontaminate, mixing, queries, va_search

VECTORS = "vec_id long, embedding array<double>"


def test_repeated_vectors_equal_the_sql(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 4)]) for i in range(60)]
    rows += [(1, rows[1][1])] * 9 + [(50, rows[50][1])] * 2 + [(50, rows[1][1]), (0, rows[1][1]), (7, rows[50][1]), (200, None), (None, rows[1][1]), (3, [1.0, 2.0])]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in queries.op1_va_search(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.OP1_SQL).fetchall())
    assert va_search.top_k(spark.createDataFrame(rows, VECTORS).where("false"), F.col("vec_id") == 0).count() == 0


def plain_leaks(docs, items):
    """Least edit distance of each item to any part of each document, by the plain table."""
    out = set()
    for d, t in docs:
        for i, item in items:
            t2, p = decontaminate.normalise(t), decontaminate.normalise(item)
            if not p:
                continue
            prev = [0] * (len(t2) + 1)
            for n, c in enumerate(p, 1):
                cur = [n]
                for j, e in enumerate(t2, 1):
                    cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != e)))
                prev = cur
            if min(prev) <= decontaminate.budget(len(p)):
                out.add((d, i, min(prev)))
    return out


def test_leaks_equal_a_plain_search_in_any_number_of_groups(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 14)))) for i in range(8)] + [(8, None), (9, " ")]
    docs = []
    for d in range(24):
        t = list(" ".join(r.choice(words) for _ in range(5)) + "  " + items[d % 8][1].upper() + "\n" + " ".join(r.choice(words) for _ in range(5)))
        for _ in range(d % 5):
            at = r.randrange(len(t))
            t[at] = r.choice(["", "x", t[at] + "y"])
        docs.append((d, "".join(t)))
    docs += [(100, None), (101, ""), (3, docs[4][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(docs, items)
    for chars in (decontaminate.GROUP_CHARS, 200):
        got = {(x.doc_id, x.item_id, x.distance) for x in decontaminate.matches(df, bench, group_chars=chars).collect()}
        assert got == want
    long = spark.createDataFrame([(1, "alpha " * 200_000 + items[0][1])], "doc_id long, text string")
    assert (1, 0) in {(x.doc_id, x.item_id) for x in decontaminate.matches(long, bench).collect()}


def test_decontaminate_keeps_clashing_names(spark):
    item = "the quick brown fox jumps over the lazy dog"
    names = ["_key", "key", "row", "item_id", "distance", "g"]
    docs = spark.createDataFrame([(1, f"a {item} b", *names), (1, "clean", *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns and [(x.doc_id, x["_key"]) for x in out.orderBy("doc_id").collect()] == [(None, "_key"), (1, "_key")]


def plain_targets(sizes, cap=3):
    """Share by weight; while a source is above its cap, it stops there and the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in rest}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_equal_plain_water_filling_and_taken_comes_near(spark):
    names = ["draws", "blocks", "passes", "crosses", "last", "s2", "s3", "b2", "h", "row", "b", "size", "taken"]
    r = random.Random(8)
    counts = {"a": 400, "b": 3, "ä": 60, "Z": 200, None: 40, "empty": 5, "c": 9}
    rows = [(n * 10_000 + i, " ".join(["w"] * (0 if s == "empty" else r.randint(1, 30))), s) for n, (s, k) in enumerate(counts.items()) for i in range(k)]
    rows.append((None, None, "a"))
    docs = spark.createDataFrame([(*x, *names) for x in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = mixing.mix(docs)
    assert [c for c in out.columns if c in docs.columns] == [c for c in docs.columns if c not in ("size", "taken")] + ["size", "taken"]
    out = out.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = plain_targets(sizes), {}
    assert any(want[s] == pytest.approx(3 * sizes[s]) and sizes[s] for s in sizes)
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and x.draws == "draws"
        assert x.taken == x["size"] * len(x.shards) and x.taken <= 3 * x["size"]
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)
    # no shard draws a copy of a document twice
    assert all(len({c.copy for c in x.shards}) == len(x.shards) for x in out)


def test_splitting_tree_halves_every_node(spark):
    draws = {"a": 1000, "b": 37, "c": 0, None: 501}
    out = mixing.splitting_tree(spark.createDataFrame(list(draws.items()), "source string, n long"), levels=3).collect()
    per = {}
    for x in out:
        per[x.shard] = per.get(x.shard, 0) + x.n
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1 and sum(per.values()) == sum(draws.values())
    for s, n in draws.items():
        mine = sorted((x.first, x.n) for x in out if x.source == s)
        assert [a for a, _ in mine] == list(np.cumsum([0, *(k for _, k in mine)])[:-1]) and sum(k for _, k in mine) == n
    a = [next((x.n for x in out if x.shard == i and x.source == "a"), 0) for i in range(8)]
    mean, sd = 125, (192.25 * (1000 / 1538) * (538 / 1538)) ** 0.5
    assert all(abs(n - 1000 / 8) < 6 * sd for n in a) and mean == 125
