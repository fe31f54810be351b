"""Registered queries over what runs leave behind: streams, reused results, listings, buckets, packs, stashes, manifests. Each
writes its store from the derived corpus and reads it back; the SQL works out the same from the tables alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.operators import discovery, projects, routing, secrets, trash
from treeledger.plans import registry as R
from treeledger.plans import reports as Q
from treeledger.sources import bucketed, listing, sinks
from treeledger.sources.corpus import corpus, entries, entries_of
from treeledger.sources.store import own_folder, written
from treeledger.streaming import repeats, scan

TS = R.TS


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, root, path, version, text: what lands in three parts. Most files come first; some come again, without their
    text or with another secret; some get their first text back."""
    code = F.substring(F.md5("path"), 1, 1)
    c = written(corpus(spark, sf_dir).withColumn("code", code), "versions")
    put = lambda rows, part, version, text: rows.select(F.lit(part).alias("part"), "root", "path", F.lit(version).cast("long").alias("version"), text.alias("text"))
    text = F.col("text")
    out = put(c.where("code < 'a'"), 0, 0, text).unionByName(put(c.where("code >= 'a'"), 1, 0, text))
    out = out.unionByName(put(c.where("code < '4'"), 1, 1, F.lit("nothing is left")))
    out = out.unionByName(put(c.where("code in ('4', '5')"), 2, 1, F.concat(F.lit("ghp_abcdefghijklmnop"), F.substring(F.md5("path"), 2, 1))))
    return out.unionByName(put(c.where("code < '2'"), 2, 2, text))


def running_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated secrets after each of three landings."""
    store, out = own_folder(spark, "repeats"), None
    rows = _versions(spark, sf_dir)
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.parquet(f"{store}/landing/part={part}")
        batch = repeats.advance(spark, f"{store}/landing", store)
        one = repeats.running_repeats(spark, f"{store}/counts", batch).withColumn("after", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return out.select("after", "value_hash", "masked", "risk", "count")


def incremental_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of contents that land in two parts, with a run after each and one more, and how often each was found."""
    store = own_folder(spark, "scan")
    c = written(corpus(spark, sf_dir), "contents")
    halves = ("substring(md5(path), 1, 1) < '8'", "substring(md5(path), 1, 1) >= '8'")
    for half in (*halves, None):
        if half is not None:
            c.where(half).write.mode("append").parquet(f"{store}/landing")
        rows = scan.contents_stream(spark, f"{store}/landing")
        scan.scan_stream(rows, f"{store}/findings", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{store}/findings")
    return found.groupBy("path", "risk", "value_hash").agg(F.count("*").alias("times"))


def _by_project(e: DataFrame) -> DataFrame:
    """Entries with every project as a root of its own."""
    rows = e.where("size(parts) > 0").withColumn("root", F.element_at("parts", 1))
    return rows.withColumn("parts", F.slice("parts", F.lit(2), F.size("parts"))).withColumn("path", P.join_parts(F.col("parts")))


def reused_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of 40 roots, looked for twice: before the second run every fifth root gets one more marker file."""
    store = own_folder(spark, "discovery")
    first = _by_project(entries(spark, sf_dir))
    added = first.select("root").distinct().where("cast(substring(root, 2) as int) % 5 = 0")
    added = added.select("root", F.lit("tools/go.mod").alias("path"), F.lit("file").alias("kind"), F.lit(7).cast("long").alias("size_bytes"), F.array(F.lit("tools"), F.lit("go.mod")).alias("parts"))
    for state, rows in enumerate((first, first.unionByName(added))):
        rows.write.partitionBy("root").parquet(f"{store}/entries-{state}")
    shape = first.schema
    for state in range(2):
        e = spark.read.schema(shape).parquet(f"{store}/entries-{state}").select(*first.columns)
        # what changes with a root: any digest of its narrow rows
        roots = e.groupBy("root").agg(F.sum(F.xxhash64("path", "kind", "size_bytes").cast("decimal(38,0)")).cast("string").alias("state"))
        found = discovery.discover(discovery.requests(roots), e, store)
    return found.select("root", "path", "name", "language", F.array_join("frameworks", "|").alias("frameworks"), projects.stack_label().alias("stack"), "size_bytes", "reused")


def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of a store that holds the corpus by project, directory name and slot, walked down to depth 3 without
    the pruned ones."""
    store = own_folder(spark, "tree")
    c = corpus(spark, sf_dir).withColumn("parts", P.parts("path"))
    rows = c.select(F.element_at("parts", 1).alias("p"), F.element_at("parts", 2).alias("d"), F.size("parts").alias("n"), F.octet_length("text").alias("b"))
    rows.write.partitionBy("p", "d", "n").parquet(store)
    root = store.removeprefix("file://").removeprefix("file:")
    policy = P.Policy(default=True, custom=("d=src", "*=5"))
    sizes = listing.directory_sizes(spark, [root], policy, max_depth=4)
    heavy = listing.heavy_directories(sizes, spark.sparkContext.defaultParallelism)
    rows = listing.list_trees(spark, [root], policy, heavy, where="depth <= 3 and pruned = false and kind = 'dir'")
    return rows.select("path", "depth")


def bucketed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of what goes into packs, by a join with stored buckets."""
    c = corpus(spark, sf_dir)
    folder = own_folder(spark, "buckets")
    stored = bucketed.write_bucketed(c, "contents_" + folder[-32:], folder, 16)
    allowed = R.stored_routes(spark, sf_dir).where("route = 'pack'").select("root", "path", "project")
    rows = bucketed.allowed_with(stored, allowed)
    return rows.select("project", "path", F.sha2("text", 256).alias("text_sha256"))


def trash_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trash.rollup(trash.trash_dirs(R.stored_entries(spark, sf_dir), R.ALL)).drop("root")


def run_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages and stashed files of three runs: one is done twice, the second time with all files; one breaks off before its
    manifest."""
    store = own_folder(spark, "manifests")
    plan = written(routing.stash_plan(corpus(spark, sf_dir)), "plan")
    stages = routing.lifecycle_stages(R.stored_routes(spark, sf_dir), trash.trash_dirs(R.stored_entries(spark, sf_dir)))
    stages = written(stages, "stages")
    critical = plan.where("risk = 'Critical'")
    for run, files in (("a", critical), ("a", plan), ("b", critical)):
        sinks.write_manifest(stages, {"secrets": "secrets/x", "pack": None}, files, store, TS, run)
    plan.select("root", "path", "size_bytes").write.json(f"{store}/manifest_files/yyyy=2026/mm=01/run=broken")
    runs, files = sinks.read_manifests(spark, store)
    n = files.groupBy("run").agg(F.count("*").alias("stashed"), F.sum("size_bytes").alias("stashed_bytes"))
    each = runs.select("run", "success", F.explode("stages").alias("s")).select("run", "success", "s.stage", "s.files", "s.bytes", "s.message")
    return each.join(n, "run", "left")


def sealed_stash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stash sealed, read back and opened; and whether a sealed text opens beside another file's path."""
    store = own_folder(spark, "stash")
    c = written(corpus(spark, sf_dir), "contents")
    key = spark.range(1).select(F.unhex(F.sha2(F.lit("a key of this query"), 256)).alias("key"))
    sinks.write_stash(routing.stash_plan(c), c, key, store, "corpus", TS)
    sealed = sinks.read_stash(spark, store)
    opened = sinks.open_stash(sealed, key)
    moved = sealed.select("root", F.concat("path", F.lit("~")).alias("path"), "sealed")
    moved = sinks.open_stash(moved, key, strict=False).select(F.expr("substring(path, 1, length(path) - 1)").alias("path"), F.col("text").isNotNull().alias("opens_elsewhere"))
    rows = opened.join(sealed.select("path", "size_bytes"), "path").join(moved, "path")
    return rows.select("path", "size_bytes", F.sha2("text", 256).alias("text_sha256"), "opens_elsewhere")


def pack_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs, read back in the order of their archives."""
    store = own_folder(spark, "packs")
    sinks.write_packs(R.stored_routes(spark, sf_dir), corpus(spark, sf_dir), store, TS)
    rows = sinks.read_packs(spark, store)
    return rows.select("slug", "position", "path", F.sha2("text", 256).alias("text_sha256"))


def report_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings as a report of JSON lines, read back."""
    store = own_folder(spark, "report")
    found = secrets.findings(corpus(spark, sf_dir))
    sinks.write_report(found, store)
    return spark.read.schema(found.schema).json(store).select("path", "risk", "label", F.array_join("rules", "|").alias("rules"), "value_hash", "original_len")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the corpus as users write them: form 0 to 6 by the hash of the path."""
    e = entries(spark, sf_dir).where("size(parts) > 0")
    form = F.conv(F.substring(F.md5("path"), 1, 4), 16, 10).cast("int") % 7
    forms = ["path", "concat('./', path)", "concat('/', path)", "concat('x/../', path)", "concat('../', path)", "concat(path, '/')", "concat(replace(path, '/', '//'), '/.')"]
    return e.select("root", "path", "kind", form.alias("form")).selectExpr("root", "path as own", "kind", "form", "case form " + " ".join(f"when {i} then {x}" for i, x in enumerate(forms)) + " end as path")


def relative_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir)
    return a.select("path", P.relative_name(F.col("path"), F.array(F.lit("p04"))).alias("name"))


def stash_only_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    asked = _asked(spark, sf_dir).select("root", "path")
    return routing.stash_only(asked, entries_of(c), c).drop("root")


_QUERIES = [
    running_repeats, incremental_findings, reused_projects, store_listing, bucketed_contents, trash_rollup, run_manifests,
    sealed_stash, pack_archives, report_read_back, relative_names, stash_only_as_written,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


_C1 = "left(md5(path), 1)"
_FORM = "cast(('0x' || left(md5(path), 4)) as integer) % 7"


def oracle_sql() -> dict[str, str]:
    base = f"{R._BASE}, {Q._F}"
    cand = R._C.replace("arg_min_null(hint, (level, ord))", "list(hint order by level, ord)[1]")
    # the corpus as it stands after each landing, as a root of its own
    landed = f"""corpus0 as (select 'corpus' as root,""", """corpus as (
      with v as (select 0 as part, path, 0 as version, text from corpus0 where c < 'a' union all select 1, path, 0, text from corpus0 where c >= 'a'
        union all select 1, path, 1, 'nothing is left' from corpus0 where c < '4'
        union all select 2, path, 1, 'ghp_abcdefghijklmnop' || substr(md5(path), 2, 1) from corpus0 where c in ('4', '5')
        union all select 2, path, 2, text from corpus0 where c < '2')
      select 'after' || k as root, path, arg_max(text, version) as text from v, unnest(range(0, 3)) as t(k) where part <= k group by k, path),
files as ("""
    text = R.CORPUS_SQL
    a, b = text.index("corpus as (select"), text.index("files as (")
    own = text[a:b].rstrip().rstrip(",").replace("corpus as (select 'corpus' as root,", landed[0]).replace(" as text from c1)", " as text, left(md5(path), 1) as c from c1)")
    own = own.replace("select 'corpus' as root,", "select * , left(md5(path), 1) as c from (select 'corpus' as root,").replace(" as text, left(md5(path), 1) as c from c1)", " as text from c1))")
    three = text[:a] + own + ",\n" + landed[1] + text[b + len("files as (") :]
    rep = "rep as (select root, value_hash, min(masked) as masked, max(r) as r, count(*) as count from f where value_hash is not null group by root, value_hash having count(*) >= 2)"
    by_project = """e0 as (select parts[1] as root, array_to_string(parts[2:], '/') as path, kind, size_bytes, parts[2:] as parts from entries where len(parts) > 0),
        e1 as (select * from e0 union all select distinct root, 'tools/go.mod', 'file', 7, ['tools', 'go.mod'] from e0 where cast(root[2:] as integer) % 5 = 0)"""
    on_e1 = lambda s: s.replace("from entries", "from e1").replace("join entries", "join e1")
    stages = f"""st as ({R._STAGE.format(0, 'stash', "routed where route = 'stash'")} union all {R._STAGE.format(1, 'trash', 'trash')} union all {R._STAGE.format(2, 'pack', "routed where route = 'pack'")})"""
    label = "case stage when 'stash' then case when files = 0 then 'nothing to stash' else 'would stash ' || files || ' files' end when 'trash' then 'found ' || files || ' directories' else 'would pack project' end"
    plan = f"{R._findings_sql('risk >= 2', '')}, plan as (select path, r, text, cast(strlen(text) as bigint) as size_bytes from f join corpus using (root, path))"
    asked = f"""asked as (select root, path as own, kind, {_FORM} as form from entries where len(parts) > 0),
        named as (select *, case form when 0 then own when 1 then './' || own when 2 then '/' || own when 3 then 'x/../' || own when 4 then '../' || own when 5 then own || '/' else replace(own, '/', '//') || '/.' end as path from asked)"""
    return {
        "running_repeats": f"{base.replace(R.CORPUS_SQL, three)}, {rep} select cast(root[6:] as integer) as after, value_hash, masked, {R._RISK}[r + 1] as risk, count from rep",
        "incremental_findings": f"{base} select path, {R._RISK}[r + 1] as risk, value_hash, cast(1 as bigint) as times from f",
        "reused_projects": f"""{R._ENTRIES}, {by_project}, {on_e1(cand)}, {on_e1(R._SIZES)}, {on_e1(R._FW)}
            select root, path, name, language, frameworks, case when language is null then '-' when frameworks = '' then language else language || ' + ' || replace(frameworks, '|', ' + ') end as stack,
                   size_bytes, cast(root[2:] as integer) % 5 <> 0 as reused from fw join sizes using (root, path)""",
        "store_listing": f"""with {R.CORPUS_SQL}, s as (select distinct 'p=' || split_part(path, '/', 1) as p, 'd=' || split_part(path, '/', 2) as d, 'n=' || len(string_split(path, '/')) as n from corpus),
            l as (select distinct p as path, 1 as depth, [p] as parts from s union all select distinct p || '/' || d, 2, [p, d] from s union all select distinct p || '/' || d || '/' || n, 3, [p, d, n] from s)
            select path, depth from l where len(list_filter(parts, lambda c: c = 'd=src' or ends_with(c, '=5') or ends_with(c, '.egg-info'))) = 0""",
        "bucketed_contents": f"{R._BASE}, {R._ROUTE.format(stash='true')} select project, path, sha256(text) as text_sha256 from routed join corpus using (root, path) where route = 'pack'",
        "trash_rollup": f"""{R._ENTRIES}, {R._TR.format(rows=R._TRASH)} select project, strategy, cast(grouping(project) * 2 + grouping(strategy) as integer) as level, count(*) as dirs, cast(sum(size_bytes) as bigint) as bytes
            from trash group by grouping sets ((root, project, strategy), (root, project), (root))""",
        "run_manifests": f"""{R._BASE}, {R._ROUTE.format(stash='true')}, {R._TR.format(rows=R._DEFAULT_TRASH)}, {stages},
            f as (select root, path, max(risk) as r from masks where risk >= 2 group by root, path), plan as (select r, cast(strlen(text) as bigint) as size_bytes from f join corpus using (root, path)),
            n as (select 'a' as run, count(*) as stashed, cast(sum(size_bytes) as bigint) as stashed_bytes from plan union all select 'b', count(*), cast(sum(size_bytes) as bigint) from plan where r = 3)
            select run, true as success, stage, files, bytes, {label} as message, stashed, stashed_bytes from st, n""",
        "sealed_stash": f"{plan} select path, size_bytes, sha256(text) as text_sha256, false as opens_elsewhere from plan",
        "pack_archives": f"""{R._BASE}, {R._ROUTE.format(stash='true')} select project || '__{TS}' as slug, row_number() over (partition by project order by string_split(path, '/')) as position, path, sha256(text) as text_sha256
            from routed join corpus using (root, path) where route = 'pack'""",
        "report_read_back": f"{R._findings_sql('true', '')} select path, {R._RISK}[r + 1] as risk, label, rules, value_hash, original_len from f",
        "relative_names": f"{R._ENTRIES}, {asked} select path, case when form not in (2, 4) and starts_with(own, 'p04/') then substr(own, 5) end as name from named",
        "stash_only_as_written": f"""{R._BASE}, {asked}, top as (select root, path, max(risk) as r from src0 group by root, path),
            a as (select distinct root, case when form in (2, 4) then path else own end as path, form in (2, 4) as outside from named)
            select a.path, case when outside then 'outside' when e.kind <> 'file' then 'not_a_file' when coalesce(r, -1) < 2 then 'below_risk' else 'selected' end as state,
                   case when not outside and r >= 2 then {R._RISK}[r + 1] end as risk, case when not outside and e.kind = 'file' then e.size_bytes end as size_bytes
            from a left join entries e on a.root = e.root and a.path = e.path and not outside left join top t on a.root = t.root and a.path = t.path and not outside""",
    }
