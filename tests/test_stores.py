"""Streams with keyed state, reused results, listings, buckets, ranks, packs, stashes and manifests, on small cases."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.operators import discovery, ordering, projects, routing, secrets, trash
from treeledger.sources import bucketed, listing, sinks
from treeledger.sources.corpus import entries_of
from treeledger.sources.store import read_pointer, turn_pointer
from treeledger.streaming import repeats

TS = "20260102T030405Z"
KEYS = ["ghp_" + "a" * 20, "ghp_" + "b" * 20, "xoxb-" + "c" * 20, "nothing", "PASSWORD=quartz-lantern-77x", None]


def contents(spark, *rows):
    return spark.createDataFrame([("r", p, t) for p, t in rows], "root string, path string, text string")


def test_running_repeats_equal_a_recomputation_after_every_batch(spark, tmp_path):
    rng = random.Random(4)
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    paths = [f"d{i % 3}/f{i}.txt" for i in range(14)] + [".env", "node_modules/x.txt"]
    newest: dict = {}
    for batch in range(4):
        rows = [("r", rng.choice(paths), rng.choice([None, *range(6)]), rng.choice(KEYS)) for _ in range(12)]
        # of rows of one version only one comes, so that the newest is told by the versions alone
        rows = list({(p, v): (r, p, v, t) for r, p, v, t in rows if v is None or (p, v) not in {(a, b) for a, (b, _) in newest.items()}}.values())
        spark.createDataFrame(rows, repeats.VERSIONS).repartition(2).write.parquet(f"{land}/part={batch}")
        if batch == 2:
            repeats.compact(spark, f"{store}/counts")
        for _, p, v, t in rows:
            v = (1 << 60) + batch if v is None else v  # the time of landing
            if p not in newest or v > newest[p][0]:
                newest[p] = (v, t)
        repeats.advance(spark, land, store)
        if batch == 1:
            repeats.advance(spark, land, store)  # nothing new
        now = contents(spark, *[(p, t) for p, (_, t) in newest.items()])
        want = secrets.repeated_counts(secrets.findings(now))
        got = repeats.running_repeats(spark, f"{store}/counts")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())), batch
    held = [n for n in os.listdir(f"{store}/counts") if n.startswith("b")]
    assert sorted(n.split("=")[0] for n in held) == ["base", "batch_id", "batch_id"]


def test_paths_that_never_held_a_secret_end_at_the_first_stream(spark, tmp_path):
    land, store, token = str(tmp_path / "land"), str(tmp_path / "store"), "ghp_zyxwvutsrqponmlk"
    parts = [[("r", f"a{i}", 1, "clean") for i in range(50)] + [("r", f"s{i}", 1, token) for i in range(3)], [("r", "s0", 2, "clean"), ("r", "s1", 0, "late"), ("r", "a0", 0, token)]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, repeats.VERSIONS).write.parquet(f"{land}/part={n}")
        repeats.advance(spark, land, store)
    through = spark.read.schema(repeats.NEWEST).parquet(f"{store}/newest").select("path", "version", F.col("value_hash").isNotNull().alias("s"))
    # a0 is told once it has held one, though the clean version is newer
    assert sorted(map(tuple, through.collect())) == [("a0", 1, False), ("s0", 1, True), ("s0", 2, False), ("s1", 1, True), ("s1", 1, True), ("s2", 1, True)]
    assert [x["count"] for x in repeats.running_repeats(spark, f"{store}/counts").collect()] == [2]


def test_batches_write_only_what_they_touch(spark, tmp_path):
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    spark.createDataFrame([("r", f"a{i}", 0, "ghp_" + f"{i % 20:020d}") for i in range(60)], repeats.VERSIONS).write.parquet(f"{land}/part=0")
    first = repeats.advance(spark, land, store)
    spark.createDataFrame([("r", "a3", 1, "clean"), ("r", "a4", 1, "ghp_" + f"{4:020d}")], repeats.VERSIONS).write.parquet(f"{land}/part=1")
    second = repeats.advance(spark, land, store)
    n = lambda b: spark.read.parquet(f"{store}/counts/batch_id={b}").count()
    assert (n(first), n(second)) == (20, 1)
    assert sorted(x["count"] for x in repeats.running_repeats(spark, f"{store}/counts").collect()) == [2, *[3] * 19]
    assert {x["count"] for x in repeats.running_repeats(spark, f"{store}/counts", first).collect()} == {3}


def make_tree(top, lopsided=400):
    for d in ("a/b/c/d", "node_modules/deep/er", "big/one", ".git"):
        (top / d).mkdir(parents=True)
    for i in range(lopsided):
        (top / "big/one" / f"f{i}").write_text("x")
    for i in range(30):
        (top / "big" / f"d{i}").mkdir()
        (top / "big" / f"d{i}" / "f").write_text("xy")
    (top / "a/b/c/d/e.txt").write_text("12")
    (top / "node_modules/deep/er/x.js").write_text("1")


def reader(top, measured=()):
    return listing.TreeReader([str(top)], P.DEFAULT, list(measured))


def test_filters_reach_the_walk(spark, tmp_path, monkeypatch):
    make_tree(tmp_path)
    everything = listing.list_trees(spark, [str(tmp_path)])
    rows = listing.list_trees(spark, [str(tmp_path)], where="depth <= 3 and not pruned and kind <> 'other'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    left = " ".join(x for x in plan.split("\n") if "Filter" in x)  # what is filtered after the scan
    assert "<=" not in left and "NOT pruned" not in left and "other" in left
    want = everything.collect()
    keep = {(x.path, x.kind) for x in want if x.depth <= 3 and not x.pruned}
    assert {(x.path, x.kind) for x in rows.collect()} == keep and ("a/b/c", "dir") in keep
    assert {x.path for x in want if x.pruned} == {".git", "node_modules", "node_modules/deep", "node_modules/deep/er", "node_modules/deep/er/x.js"}
    assert listing.list_trees(spark, [str(tmp_path)], where=F.col("root") == "elsewhere").count() == 0
    # one listing serves queries of several filters
    assert everything.where("depth <= 1").count() == sum("/" not in x.path for x in want) < everything.count() == len(want)
    assert rows.where("depth <= 1").count() < rows.where("kind = 'dir'").count() < rows.count() == len(keep)
    # the same through the reader: what is excluded isn't opened
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    r = reader(tmp_path)
    assert list(r.pushFilters([LessThan(("depth",), 3), EqualTo(("pruned",), False), GreaterThan(("size_bytes",), 0)])) == [GreaterThan(("size_bytes",), 0)]
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or scandir(p))
    found = [x for part in r.partitions() for x in r.read(part)]
    assert not any(p.startswith("node_modules") or p.count("/") > 0 for p in opened) and "big" in opened
    assert {x[1] for x in found} == {p for p, _ in keep if p.count("/") < 2}


def test_no_task_has_much_more_than_the_mean(spark, tmp_path):
    make_tree(tmp_path, 3000)
    sizes = listing.directory_sizes(spark, [str(tmp_path)], prune=False)
    plain = {os.path.relpath(d, tmp_path).replace(".", "", 1) if d == str(tmp_path) else os.path.relpath(d, tmp_path): 0 for d, _, _ in os.walk(tmp_path)}
    for d, dirs, files in os.walk(tmp_path):
        at = os.path.relpath(d, tmp_path)
        at = "" if at == "." else at
        while True:
            plain[at] += len(dirs) + len(files)
            if not at:
                break
            at = os.path.dirname(at)
    assert {x.dir: x.entries for x in sizes.collect()} == plain
    tasks = 8
    heavy = listing.heavy_directories(sizes, tasks)
    assert len(heavy) <= 2 * tasks * 5
    r = reader(tmp_path, heavy)
    each = [[x[1] for x in r.read(p)] for p in r.partitions()]
    found = [x for e in each for x in e]
    assert sorted(found) == sorted(os.path.relpath(os.path.join(d, n), tmp_path) for d, dirs, files in os.walk(tmp_path) for n in dirs + files)
    assert max(map(len, each)) <= 2 * len(found) / tasks
    assert listing.list_trees(spark, [str(tmp_path)], measured=heavy).count() == len(found)


def test_buckets_stay_in_place(spark, tmp_path):
    rows = [(f"r{i % 3}", f"p/{i}", "text " * (i % 7)) for i in range(300)]
    c = spark.createDataFrame(rows, "root string, path string, text string")
    stored = bucketed.write_bucketed(c, "own_contents", str(tmp_path / "b"), 4)
    allowed = c.where("length(text) > 20").select("root", "path")
    for df in (bucketed.allowed_contents(stored, allowed.union(allowed)), bucketed.allowed_with(stored, allowed.withColumn("slug", F.lit("s")))):
        assert df.count() == sum(len(t) > 20 for _, _, t in rows)
        plan = df._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("own_contents") - 1500 : plan.index("own_contents")]
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning(root") - plan.count("Exchange hashpartitioning(root#0") <= 2, side
    # the branch that holds the texts is never dealt out
    lines = bucketed.allowed_contents(stored, allowed).select("root", "path", "text")._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("Exchange" in x and "text" in x for x in lines)
    spark.sql("DROP TABLE own_contents")
    again = bucketed.open_bucketed(spark, "own_contents_2", str(tmp_path / "b"), 4)
    assert sorted(map(tuple, bucketed.allowed_contents(again, allowed).collect())) == sorted(r for r in rows if len(r[2]) > 20)
    with pytest.raises(ValueError):
        bucketed.write_bucketed(c, "bad name", str(tmp_path / "x"), 4)


def test_places_in_an_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["one", "one", "one", "two", None]), rng.randrange(50), f"x{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "root string, w int, path string").repartition(5)
    keys = [-F.col("w"), F.col("path")]
    got = {r.path: r.position for r in ordering.ranked(df, keys).collect()}
    assert got == {p: i for i, (_, _, p) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)}
    ranked = ordering.ranked(df, keys, within="root")
    got = {r.path: r.position for r in ranked.collect()}
    for root in ("one", "two", None):
        mine = sorted((r for r in rows if r[0] == root), key=lambda r: (-r[1], r[2]))
        assert [got[p] for _, _, p in mine] == list(range(1, len(mine) + 1))
    plan = ranked._jdf.queryExecution().analyzed().toString()
    assert plan.count("Window [") <= 2 and "windowspecdefinition(root" not in plan  # over parts, never over a root's rows
    assert ordering.ranked(df.limit(0), keys, within="root").collect() == []


def root_entries(spark, names):
    rows = []
    for root, files in names.items():
        dirs = {""} | {"/".join(f.split("/")[:i]) for f in files for i in range(1, f.count("/") + 1)}
        rows += [(root, d, "dir", 0) for d in dirs] + [(root, f, "file", 10) for f in files]
    e = spark.createDataFrame(rows, "root string, path string, kind string, size_bytes long")
    return e.withColumn("parts", P.parts("path"))


def test_only_changed_roots_are_read(spark, tmp_path):
    names = {f"r{i}": ["Cargo.toml", f"x{i}/go.mod"] for i in range(6)}
    e = root_entries(spark, names)
    e.write.partitionBy("root").parquet(str(tmp_path / "e"))
    store = str(tmp_path / "store")
    at = lambda: spark.read.schema(e.schema).parquet(str(tmp_path / "e")).select(*e.columns)
    asked = lambda *changed, **o: discovery.requests(spark.createDataFrame([(r, "new" if r in changed else "old") for r in names], "root string, state string"), **o)
    want = lambda: {(x.root, x.path, x.size_bytes) for x in projects.projects(at()).collect()}
    seen = lambda df: {(x.root, x.path, x.size_bytes) for x in df.collect()}
    reused = lambda df: {x.root for x in df.where("reused").select("root").distinct().collect()}
    full = want()
    first = discovery.discover(asked(), at(), store)
    assert seen(first) == full and reused(first) == set()
    for r in ("r0", "r1", "r2", "r3"):  # had they been read, their projects would be gone
        shutil.rmtree(tmp_path / f"e/root={r}")
    second = discovery.discover(asked("r4"), at(), store)
    assert seen(second) == full and reused(second) == set(names) - {"r4"}
    discovery.compact(spark, store)
    third = discovery.discover(asked("r4"), at(), store)
    assert seen(third) == full and reused(third) == set(names)
    # another depth, tool or policy, and a refresh, find nothing to use
    for o in ({"max_depth": 3}, {"tool": "2"}, {"policy": "own"}):
        assert reused(discovery.discover(asked("r4", **o), at(), str(tmp_path / "store"), keep=False)) == set()
    again = discovery.discover(asked("r4"), at(), store, refresh=True, keep=False)
    assert reused(again) == set() and seen(again) == {x for x in full if x[0] in ("r4", "r5")}
    # a generation that is gone is a miss, and so is a broken index
    for g in os.listdir(f"{store}/results"):
        if g.startswith("generation"):
            shutil.rmtree(f"{store}/results/{g}")
    assert reused(discovery.discover(asked("r4"), at(), store, keep=False)) == set()


def test_pointers(spark, tmp_path):
    p = str(tmp_path / "pointer")
    assert read_pointer(spark, p) is None
    for i in range(12):
        turn_pointer(spark, p, f"index-{i}")
    assert read_pointer(spark, p) == "index-11"
    with pytest.raises(ValueError):
        turn_pointer(spark, p, "../x")


def test_a_stash_opens_only_in_its_place(spark, tmp_path):
    store = str(tmp_path)
    c = contents(spark, ("a/.env", KEYS[0]), ("b/.env", KEYS[1]), ("ab", "none"))
    key = spark.createDataFrame([(bytearray(range(32)),)], "key binary")
    sinks.write_stash(routing.stash_plan(c), c, key, store, "p", TS)
    sealed = sinks.read_stash(spark, store)
    assert {(x.path, x.text) for x in sinks.open_stash(sealed, key).collect()} == {("a/.env", KEYS[0]), ("b/.env", KEYS[1])}
    other = F.when(F.col("path") == "a/.env", "b/.env").otherwise("a/.env")
    swapped = sealed.withColumn("path", other)
    assert [x.text for x in sinks.open_stash(swapped, key, strict=False).collect()] == [None, None]
    with pytest.raises(Exception, match="AES|Tag|tag"):
        sinks.open_stash(swapped, key).collect()
    # root and path together name the place: ("r", "a/.env") isn't ("ra", "/.env")
    moved = sealed.selectExpr("concat(root, 'a') as root", "substring(path, 2) as path", "sealed").where("path = '/.env'")
    assert {x.text for x in sinks.open_stash(moved, key, strict=False).collect()} == {None}
    wrong = spark.createDataFrame([(bytearray(32),)], "key binary")
    assert {x.text for x in sinks.open_stash(sealed, wrong, strict=False).collect()} == {None}


def test_packs_in_archive_order(spark, tmp_path):
    c = contents(spark, *[(f"p{i % 2}/d{i % 7}/{i}.txt", str(i)) for i in range(500)], ("p0/.env", KEYS[0]))
    sinks.write_packs(routing.routes(c), c, str(tmp_path), TS)
    got = sinks.read_packs(spark, str(tmp_path)).collect()
    for p in ("p0", "p1"):
        mine = sorted((x for x in got if x.project == p), key=lambda x: x.position)
        assert [x.position for x in mine] == list(range(1, 251))
        paths = [x.path for x in mine]
        assert paths == sorted(paths, key=lambda x: x.split("/")) and all(x.text == x.path.split("/")[-1][:-4] for x in mine)


def test_manifests_are_written_once(spark, tmp_path):
    store = str(tmp_path)
    stages = spark.createDataFrame([(0, "stash", 1, 2, "m")], "ord int, stage string, files long, bytes long, message string")
    files = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "root string, path string, size_bytes long")
    for run, rows in (("x", files), ("x", files), ("y", files), ("y", files.limit(0))):
        sinks.write_manifest(stages, {"pack": "packs/x"}, rows, store, TS, run)
    runs, held = sinks.read_manifests(spark, store)
    assert sorted(r.run for r in runs.collect()) == ["x", "y"] and sorted((r.run, r.path) for r in held.collect()) == [("x", "a"), ("x", "b")]
    broken = stages.withColumn("message", F.raise_error(F.lit("stop")).cast("string"))
    for run in ("z", "x"):  # a run that fails, also when it is done again, leaves no manifest
        with pytest.raises(Exception, match="stop"):
            sinks.write_manifest(broken, {"pack": "packs/x"}, files, store, TS, run)
    runs, held = sinks.read_manifests(spark, store)
    assert [r.run for r in runs.collect()] == ["y"] and held.count() == 0
    with pytest.raises(ValueError):
        sinks.write_manifest(stages, {"pack": "packs/x"}, files, store, TS, "../up")


def test_reports_and_rollups(spark, tmp_path):
    found = secrets.findings(contents(spark, ("a", KEYS[0]), ("b/.env", "x")))
    for fmt in ("json", "parquet"):
        sinks.write_report(found, str(tmp_path / fmt), fmt)
        back = spark.read.schema(found.schema).format(fmt).load(str(tmp_path / fmt))
        assert sorted(back.collect()) == sorted(found.collect()) and back.columns[:3] == ["root", "path", "risk"]
    with pytest.raises(Exception, match="exists"):
        sinks.write_report(found, str(tmp_path / "json"))
    t = spark.createDataFrame([("r", "p", "rust", 1), ("r", "p", "node", 2), ("r", None, "node", 4), ("s", "p", "rust", 8)], "root string, project string, strategy string, size_bytes long")
    got = {(x.root, x.project, x.strategy, x.level): (x.dirs, x.bytes) for x in trash.rollup(t).collect()}
    assert got[("r", None, None, 3)] == (3, 7) and got[("r", None, None, 1)] == (1, 4) and got[("r", "p", None, 1)] == (2, 3)
    assert got[("s", "p", "rust", 0)] == (1, 8) and len(got) == 9


def test_paths_as_written(spark):
    cases = {"a/b": "a/b", "./a//b/": "a/b", "a/../b": "b", "/a": None, "../a": None, "a/../../a": None, "": "", ".": "", "a/..": "", "..a/b": "..a/b"}
    rows = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {x.path: None if x.p is None else "/".join(x.p) for x in rows.select("path", P.resolved(F.col("path")).alias("p")).collect()}
    assert got == cases
    c = contents(spark, ("a", KEYS[0]), ("etc/passwd", "x"))
    asked = spark.createDataFrame([("r", p) for p in ("./a", "a", "b/../a", "/etc/passwd", "etc/passwd", "b/../../a")], "root string, path string")
    got = sorted((x.path, x.state) for x in routing.stash_only(asked, entries_of(c), c).collect())
    assert got == [("/etc/passwd", "outside"), ("a", "selected"), ("b/../../a", "outside"), ("etc/passwd", "below_risk")]


def test_sizes_of_projects_and_trash_equal_a_plain_walk(spark):
    rng = random.Random(11)
    names = ["src", "target", "node_modules", "a", "b", "x.egg-info", "dist", ".hid"]
    files = {"/".join([*(rng.choice(names) for _ in range(rng.randrange(9))), f"f{i}"]): rng.randrange(100) for i in range(400)}
    dirs = {"/".join(f.split("/")[:i]) for f in files for i in range(f.count("/") + 1)}
    rows = [("r", d, "dir", 0) for d in dirs] + [("r", f, "file", n) for f, n in files.items()]
    e = spark.createDataFrame(rows, "root string, path string, kind string, size_bytes long").withColumn("parts", P.parts("path"))
    found = e.where("kind = 'dir'").select("root", "path")
    for policy, depth in ((P.DEFAULT, 6), (P.EMPTY, 3), (P.Policy(custom=("*b",), hidden=True), 2)):
        got = {x.path: x.size_bytes for x in projects.project_sizes(found, e, depth, policy).collect()}
        want = dict.fromkeys(dirs, 0)
        for f, n in files.items():
            parts = f.split("/")
            for k in range(len(parts)):
                own = parts[k:-1]
                if len(parts) - k <= depth and not any(listing.prunes(policy, c) for c in own):
                    want["/".join(parts[:k])] += n
        assert got == want
    for strategies, depth in ((trash.DEFAULT_STRATEGIES, 6), (("node",), 2)):
        fits = lambda c: any(c.endswith(p[1:]) if p.startswith("*") else c == p for s, p in trash.trash_patterns(strategies))  # noqa: B023, E731
        outer = {d for d in dirs if 2 <= d.count("/") + 1 <= depth + 1 and fits(d.split("/")[-1]) and not any(fits(c) for c in d.split("/")[1:-1])}
        got = {x.path: x.size_bytes for x in trash.trash_dirs(e, strategies, depth).collect()}
        assert got == {d: sum(n for f, n in files.items() if f.startswith(d + "/")) for d in outer} and outer
