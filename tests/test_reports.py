"""User rules, orders, packs that are written again, cleaned files in a stream, and more queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.rules import CONTENT_GATE
from treeledger.operators import ordering, projects, routing, secrets
from treeledger.plans import reports
from treeledger.sources import sinks
from treeledger.streaming import repeats

SF = "/root/testdata/sf0.001"
TOKEN = "ghp_zyxwvutsrqponmlk"


def contents(spark, *rows):
    return spark.createDataFrame([("r", p, t) for p, t in rows], "root string, path string, text string")


@pytest.mark.parametrize("name", ["filename_scan", "findings_own_rules", "binary_contents", "routes_in_trash", "lifecycle_switches", "run_names"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(reports.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = sorted(map(repr, (tuple(x[c] for c in columns) for x in reports.queries()[name](spark, SF).collect())))
    assert got == sorted(map(repr, want.fetchall()))


def test_sizes_round_exact_halves_to_even(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 1331, 1332, 1048575, 1048576, 1310720, 1835008, 1048576 * 9 + 1048576 // 20 * 19, 2147483647, 1024**3 + 2**28, 5 * 10**18]
    rows = spark.createDataFrame([(b,) for b in sizes], "b long").select("b", P.human_size(F.col("b")).alias("size")).collect()
    units = [("TiB", 1 << 40), ("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)]
    assert [x["size"] for x in rows] == [next((f"{b / u:.1f} {n}" for n, u in units if b >= u), f"{b} B") for b in sizes]


def test_mib_labels_round_exact_halves_to_even(spark):
    sizes = [0, 1, 32768000, 98304000, 32768000 * 7, 52428, 52429, 1048575, -32768000, -1, 10**15]
    rows = spark.createDataFrame([(b,) for b in sizes], "b long").select(P.mib_label(F.col("b")).alias("size")).collect()
    assert [x["size"] for x in rows] == [f"{b / 1048576:.1f} MiB" for b in sizes]


def test_rules_are_checked_before_a_job_starts(spark):
    c = contents(spark, ("a", "x"))
    for bad in ({"markers": [("m", "regex", "(", "High", "x")]}, {"markers": [("m", "glob", "a", "High", "x")]}, {"patterns": [("exact", "", "High", "p", "x")]}, {"patterns": [("exact", "a", "Dire", "p", "x")]}, {"max_depth": 0}):
        with pytest.raises(ValueError):
            secrets.findings(c, **bad)
    with pytest.raises(ValueError):
        projects.candidates(c.selectExpr("root", "path", "'file' as kind", "split(path, '/') as parts"), max_depth=0)


def test_gate_loses_no_hit(spark):
    texts = ["PASSWORD=abcdefgh1", "paſſword: abcdefgh1", "TOKEN=abcdefgh1", "apı_key=abcdefghijklmnop1", "x\nmysql://a:b@c\ny", "-----BEGIN EC PRIVATE KEY-----", "clean", "", "gho_x AKIA"]
    rows = contents(spark, *((str(i), t) for i, t in enumerate(texts)))
    got = rows.select("path", F.size(secrets.content_sources("text")).alias("all"), F.size(secrets.content_sources_of(F.col("text"))).alias("gated")).collect()
    assert all(x["all"] == x.gated for x in got) and sum(x.gated > 0 for x in got) >= 7


def test_light_gate_lets_every_default_marker_through(spark):
    """Each marker alone, in its folded forms and with white space of Unicode before its sign; prose stops at the gate."""
    nb, k = "\u00a0", "\u212a"
    texts = ["AKIA", "AWS_ſecret_acceſſ_" + k + "ey = x", "api-key: abcdefghijklmnop", "apı" + k + f"EY{nb}=abcdefghijklmnop", "API_KEY\t:'abcdefghijklmnop"]
    texts += [f"{w}{gap}{sign}abcdefgh" for w in ("secret", "SECRET", "ſecret", "password", "PASSWORD", "paſſwd", "passwd", "token", "TO" + k + "EN") for gap in ("", " ", nb, "\u2003") for sign in ":="]
    texts += [f"-----BEGIN {x}PRIVATE KEY-----" for x in ("", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED ")] + ["-----BEGINPRIVATE KEY-----"]
    texts += ["ghp_", "gho_", "xoxb-", "sk_live_", "sk_test_", "poſtgreſ://a:b@", "MySQL://a:b@", "mongodb://a:b@", "eyJa.eyJb.c"]
    prose = ["A well-known tale. All of this: none; K. and B. have spoken (token, secret, password)."] * 3
    rows = contents(spark, *((str(i), f"é {t} z") for i, t in enumerate(texts + prose)))
    got = rows.select("text", F.size(secrets.content_sources("text")).alias("n"), F.col("text").rlike(CONTENT_GATE).alias("through"), secrets.may_hold(F.col("text")).alias("may")).collect()
    assert not [x.text for x in got if x.n and not (x.through and x.may)] and sum(x.n > 0 for x in got) == len(texts)
    assert {x.through for x in got if x.text == f"é {prose[0]} z"} == {False}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_policies_are_told_from_one_look_at_the_texts(spark):
    c = contents(spark, ("a.txt", TOKEN), ("b.txt", "x"))
    for rows, codes in ((c, [0, 2, 2]), (c.where("path = 'b.txt'"), [0, 0, 0])):
        got = secrets.risk_gates(secrets.findings(rows))
        assert [x.exit_code for x in got.orderBy(F.expr("array_position(array('ignore', 'critical', 'high'), policy)")).collect()] == codes
    assert _plan(reports.R.risk_gate(spark, SF)).count("Relation [") == 1


def test_whole_scan_reads_the_texts_once(spark):
    """What is left to do after the findings are written looks for no marker."""
    c = contents(spark, ("a.txt", TOKEN), ("b/c.txt", TOKEN), ("d.txt", "x"))
    entries = c.selectExpr("root", "path", "'file' as kind", "1L as size_bytes", "split(path, '/') as parts")
    job = secrets.scan_job(c, entries, c.selectExpr("root", "path", "'modified' as status"))
    assert not [k for k, df in job.items() if "regexp_extract_all" in _plan(df)]
    assert job["summary"].select("files_scanned", "findings", "repeated", "exit_code").collect() == [(3, 2, 1, 2)]


def test_status_outside_reads_the_texts_once(spark):
    assert "regexp_extract_all" not in _plan(reports.git_status_outside(spark, SF))


def test_plan_of_a_stash_needs_no_join(spark):
    plan = routing.stash_plan(contents(spark, ("a.txt", "é " + TOKEN), ("b.txt", "x")))
    assert "Join" not in _plan(plan) and plan.collect() == [("r", "a.txt", "Critical", 23)]


def test_order_numbers_rows_by_components(spark):
    paths = ["a-b/x", "a/b", "a", "a/b/c/d", "z/y/x", "a/b/c", "z", "a b/q"]
    rows = spark.createDataFrame([("r", p, i % 3) for i, p in enumerate(paths)] + [("s", "only", 1)], "root string, path string, w int")
    got = {(x.root, x.path): x.position for x in ordering.in_order(rows).collect()}
    want = {("r", p): n for n, p in enumerate(sorted(paths, key=lambda p: p.split("/")), 1)} | {("s", "only"): 1}
    assert got == want
    heavy = {x.path: x.position for x in ordering.in_order(rows.where("root = 'r'"), first=F.col("w")).collect()}
    assert heavy == {p: n for n, p in enumerate(sorted(paths, key=lambda p: (-(paths.index(p) % 3), p.split("/"))), 1)}


def test_packs_can_be_written_again_and_equal_slugs_stay_apart(spark, tmp_path):
    c = contents(spark, ("my app/a.txt", "1"), ("my-app/b.txt", "2"), ("other/c.txt", "3"))
    for _ in range(2):
        sinks.write_packs(routing.routes(c), c, str(tmp_path), "20260102T030405Z")
    packed = spark.read.parquet(f"{tmp_path}/packs").collect()
    assert sorted(x.path for x in packed) == ["my app/a.txt", "my-app/b.txt", "other/c.txt"]
    assert len({x.slug for x in packed}) == 3


def test_manifest_tells_of_failed_stages(spark, tmp_path):
    c = contents(spark, ("p/a.txt", "1"))
    trash = spark.createDataFrame([("r", 1)], "root string, size_bytes long")
    errors = spark.createDataFrame([("r", "pack", "no space")], "root string, stage string, message string")
    plan = routing.lifecycle_plan(routing.routes(c), trash, stash=False, errors=errors)
    assert {x.stage: (x.message, x.ok) for x in plan.collect()} == {"stash": ("disabled", True), "trash": ("found 1 directories", True), "pack": ("no space", False)}
    sinks.write_manifest(plan, {"pack": "packs/x"}, c.limit(0).withColumn("size_bytes", F.lit(0)), str(tmp_path), "20260102T030405Z")
    assert [x.success for x in spark.read.json(f"{tmp_path}/manifests").collect()] == [False]


def test_cleaned_files_leave_the_running_repeats(spark, tmp_path):
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    contents(spark, ("a.txt", TOKEN), ("b.txt", TOKEN)).write.mode("append").parquet(land)
    repeats.advance(spark, land, store)
    assert [x["count"] for x in repeats.running_repeats(spark, f"{store}/counts").collect()] == [2]
    contents(spark, ("b.txt", "clean now")).write.mode("append").parquet(land)
    repeats.advance(spark, land, store)
    assert repeats.running_repeats(spark, f"{store}/counts").count() == 0


def test_policies_and_scope(spark):
    c = contents(spark, ("p/src/.env", "x"), ("p/.hid/.env", "x"), ("p/target/.env", "x"), ("q/.env", "x"))
    found = lambda **o: sorted(x.path for x in secrets.findings(c, **o).collect())
    assert found() == ["p/.hid/.env", "p/src/.env", "q/.env"]
    assert found(policy=P.Policy(custom=("src",), hidden=True)) == ["q/.env"]
    assert len(found(policy=P.EMPTY)) == 4
    assert sorted((x.root, x.path) for x in secrets.findings(secrets.scope(c, "p")).collect()) == [("r/p", ".hid/.env"), ("r/p", "src/.env")]
