"""Listing, status records, the store and the streams, on small cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from treeledger.operators import repositories, routing, secrets
from treeledger.sources import listing, sinks
from treeledger.sources.corpus import entries_of
from treeledger.streaming import scan

KEY = "ghp_abcdefghijklmnop"
TS = "20260102T030405Z"


def contents(spark, *rows):
    return spark.createDataFrame([("r", p, t) for p, t in rows], "root string, path string, text string")


def test_listing_sees_dot_files_and_follows_no_link(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".env").write_text("x=1")
    (tmp_path / "a/b/_x").write_text("12345")
    os.symlink(tmp_path / "a", tmp_path / "link")
    rows = listing.list_trees(spark, [str(tmp_path), str(tmp_path / "gone")]).collect()
    got = {(x.path, x.kind, x.size_bytes) for x in rows if x.root == str(tmp_path)}
    assert got == {(".env", "file", 3), ("a", "dir", 0), ("a/b", "dir", 0), ("a/b/_x", "file", 5), ("link", "symlink", 0)}
    assert [(x.kind, x.error) for x in rows if x.root.endswith("gone")] == [("error", "FileNotFoundError")]


def plain_status(raw):
    fields, found, i = [f for f in raw.split("\0") if f], {}, 0
    while i < len(fields):
        f = fields[i]
        i += 1
        if len(f.encode()) < 4:
            continue
        if "R" in f[:2] or "C" in f[:2]:
            i += 1
        found[f[3:]] = f[:2]
    return found


def test_status_records_match_a_plain_reader(spark):
    rng = random.Random(5)
    pool = ["?? a.txt", " M b", "R  new", "README.md", "C  Copy", "CC x", "A  q", "!! ign", "RR", "old", " D gone", "", "R  R  R"]
    raws = ["\0".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    rows = spark.createDataFrame([("r", str(i), x) for i, x in enumerate(raws)], "root string, repo string, raw string")
    code = {x: y for x, y in spark.createDataFrame([(c,) for c in {p[:2] for p in pool}], "c string").select("c", secrets.git_status_of(F.col("c"))).collect()}
    got = {}
    for x in repositories.parse_status(rows).collect():
        got.setdefault(x.repo, {})[x.path] = x.status
    for i, x in enumerate(raws):
        assert got.get(str(i), {}) == {p: code[c] for p, c in plain_status(x).items()}


def test_nearest_repository(spark):
    c = contents(spark, (".git/HEAD", "x"), ("a/.git", "gitdir: y"), ("a/b/f", "z"), ("g", "z"), ("ab/f", "z"))
    e = entries_of(c)
    near = {x.path: x.repo for x in repositories.nearest_repository(c, e).collect()}
    assert near["a/b/f"] == "a" and near["g"] == "" and near["ab/f"] == ""
    assert {x.repo for x in repositories.nearest_repository(c, e, scope="root").collect()} == {""}


def test_explicit_list(spark):
    c = contents(spark, ("node_modules/k", KEY), ("ok.txt", "nothing"))
    asked = spark.createDataFrame([("r", p) for p in ("node_modules/k", "node_modules/k", "ok.txt", "node_modules", "no", "../up")], "root string, path string")
    rows = routing.stash_only(asked, entries_of(c), c).collect()
    assert sorted((x.path, x.state) for x in rows) == [("../up", "outside"), ("no", "missing"), ("node_modules", "not_a_file"), ("node_modules/k", "selected"), ("ok.txt", "below_risk")]
    with pytest.raises(Exception, match="not_a_file|missing|outside"):
        routing.stash_only(asked, entries_of(c), c, strict=True).collect()


def test_roots_and_version(spark, tmp_path):
    e = spark.createDataFrame([("a", "", "dir"), ("b", "", "file")], "root string, path string, kind string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "root string")
    assert sorted(map(tuple, sinks.check_roots(e, asked).collect())) == [("b", "not_a_directory"), ("c", "missing")]
    store = str(tmp_path / "store")
    sinks.check_version(spark, store)
    sinks.check_version(spark, store, "1.9")
    with pytest.raises(ValueError):
        sinks.check_version(spark, store, "2.0")


def test_free_names(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {x.name: x.final for x in sinks.free_names(names("a", "b"), names("a", "c"), "0a1b2c3d").collect()}
    assert got == {"a": "a__0a1b2c3d", "b": "b"}
    with pytest.raises(Exception, match="name collision"):
        sinks.free_names(names("a"), names("a", "a__0a1b2c3d"), "0a1b2c3d").collect()


def test_lifecycle_into_a_store(spark, tmp_path):
    store = str(tmp_path)
    c = contents(spark, ("p/.env", "PASSWORD=quartz-lantern-77x"), ("p/z.txt", "z"), ("p/a.txt", "a"), ("p/node_modules/k.js", "x"))
    plan = routing.stash_plan(c)
    key = spark.createDataFrame([(bytearray(b"0123456789abcdef"),)], "key binary")
    put = sinks.write_stash(plan, c, key, store, "p", TS)
    assert [x.path for x in put.collect()] == ["p/.env"]
    sealed = sinks.read_stash(spark, store)
    assert sinks.open_stash(sealed, key).first().text == "PASSWORD=quartz-lantern-77x"
    with pytest.raises(ValueError):
        sinks.write_stash(plan.where("false"), c, key, store, "p", TS)
    with pytest.raises(ValueError):
        sinks.write_stash(plan, c, key.where("false"), store, "q", TS)
    routed = routing.routes(c)
    sinks.write_packs(routed, c, store, TS)
    packed = spark.read.parquet(f"{store}/packs")
    assert [x.path for x in packed.orderBy("parts").collect()] == ["p/a.txt", "p/z.txt"]
    trash = spark.createDataFrame([("r", 1)], "root string, size_bytes long")
    sinks.write_manifest(routing.lifecycle_stages(routed, trash), {"secrets": "secrets/2026/01/p", "pack": None}, put, store, TS)
    one = spark.read.json(f"{store}/manifests").collect()
    assert len(one) == 1 and [s.stage for s in one[0].stages] == ["stash", "trash", "pack"]
    assert "quartz" not in str(one)
    with pytest.raises(ValueError):
        sinks.write_manifest(routing.lifecycle_stages(routed, trash), {"pack": "/abs"}, put, store, TS)


def test_result_reuse(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).select(F.col("id").alias("n"))

    ask = lambda depth=6, tool="1", **o: sinks.reuse(spark, str(tmp_path), "r", depth, "p", tool, build, **o)
    assert [ask()[1], ask()[1], ask(7)[1], ask(tool="2")[1], ask(tool="2")[1], ask(tool="2", refresh=True)[1]] == [False, True, False, False, True, False]
    assert len(calls) == 4 and ask(tool="2")[0].columns == ["n"]


def test_streams_scan_once(spark, tmp_path):
    land, out = (str(tmp_path / x) for x in ("land", "out"))

    def run():
        scan.scan_stream(scan.contents_stream(spark, land), out, f"{out}-c").trigger(availableNow=True).start().awaitTermination()

    contents(spark, ("a.txt", KEY), ("b.txt", "none")).write.mode("append").parquet(land)
    run()
    assert spark.read.parquet(out).count() == 1
    contents(spark, ("c.txt", KEY)).write.mode("append").parquet(land)
    run()
    run()
    assert sorted(x.path for x in spark.read.parquet(out).collect()) == ["a.txt", "c.txt"]
