"""More registered queries over the derived corpus, with their SQL: reports, user rules, whole jobs, small columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.operators import projects, repositories, routing, secrets, trash
from treeledger.plans import registry as R
from treeledger.sources import sinks
from treeledger.sources.corpus import corpus, entries, entries_of
from treeledger.sources.store import written

TS = R.TS
CUSTOM = P.Policy(default=True, custom=("src", "*ui"), hidden=True)
OWN_NAMES = (("suffix", ".txt", "Medium", "own_text", "Text"), ("exact", "HEAD", "High", "own_head", "Head"), ("contains", "f1", "High", "own_f1", "One"))
OWN_MARKERS = (("own_literal", "contains", "_key", "High", "Key literal"), ("own_number", "regex", "[0-9]{6,}", "Critical", "Number"), ("own_prefix", "prefix", "xoxb-", "Low", "Token"))
OWN_FRAMEWORKS = [("Deployed", ("package.json", "Cargo.toml"), ("kubeconfig", "id_rsa")), ("Config", ("Cargo.toml", "pyproject.toml"), ("config/app.cfg",)), ("Any", ("Makefile",), ("main.*",))]


def filename_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.filename_scan(corpus(spark, sf_dir)).drop("root")


def filename_scan_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.filename_scan(corpus(spark, sf_dir), min_risk="High").drop("root")


def _rank(risk: str = "risk"):
    return F.array_position(F.array(*map(F.lit, secrets.RISKS)), F.col(risk)).cast("int") - 1


def findings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(corpus(spark, sf_dir)).select("root", "path", "risk", P.primary_label(F.col("labels")).alias("label"), P.hash_preview(F.col("value_hash")).alias("preview"))
    by_path = secrets.in_order(found, position="by_path")
    return secrets.in_order(by_path, first=_rank(), position="by_risk").drop("root")


def repeats_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = secrets.repeated_counts(secrets.findings(corpus(spark, sf_dir))).withColumn("path", F.col("value_hash"))
    return secrets.in_order(r, first=_rank()).select("value_hash", "masked", "risk", "count", "position")


def repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.repeated_paths(secrets.findings(corpus(spark, sf_dir))).drop("root")


def candidates_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.in_order(projects.candidates(entries(spark, sf_dir)).select("root", "path")).drop("root")


def trash_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trash.trash_dirs(R.stored_entries(spark, sf_dir), R.ALL).select("root", "path", P.mib_label(F.col("size_bytes")).alias("size"))
    return secrets.in_order(t).drop("root")


def stash_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.in_order(routing.stash_plan(corpus(spark, sf_dir))).drop("root")


def findings_custom_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(corpus(spark, sf_dir), policy=CUSTOM).select("path", "risk")


def findings_no_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(corpus(spark, sf_dir), policy=P.EMPTY, max_depth=64).select("path", "risk")


def candidates_custom_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.candidates(entries(spark, sf_dir), policy=CUSTOM).select("path", "is_git_repo")


def findings_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(corpus(spark, sf_dir), patterns=OWN_NAMES, markers=OWN_MARKERS)
    return found.select("path", "risk", F.array_join("rules", "|").alias("rules"), "value_hash")


def frameworks_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.stored_entries(spark, sf_dir)
    rows = projects.with_stack(projects.candidates(e), e, OWN_FRAMEWORKS)
    return rows.select("path", F.array_join("frameworks", "|").alias("frameworks"))


def stacks_without_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projects.with_stack(projects.candidates(entries(spark, sf_dir)), None)
    return rows.select("path", "language", projects.stack_label().alias("stack"))


def binary_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as bytes: a NUL after n characters of two bytes, and before every other text a byte that is no UTF-8."""
    c = corpus(spark, sf_dir).withColumn("n", F.pmod(F.length("text"), F.lit(10)) * 1000)
    head = F.expr("concat(repeat('é', cast(n as int)), char(0), text)").cast("binary")
    c = c.withColumn("content", F.when(F.col("n") % 2000 == 0, head).otherwise(F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"))))
    rows = secrets.from_bytes(c.select("root", "path", "n", "content"))
    return rows.select("path", F.col("text").isNotNull().alias("scanned"), F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, 1).alias("first"))


def contents_after_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return secrets.read_eligible(c, entries_of(c), max_bytes=2000).select("path", F.octet_length("text").cast("long").alias("size_bytes"))


def scoped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(secrets.scope(corpus(spark, sf_dir), "p04")).select("root", "path", "risk")


def git_status_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    found = written(secrets.findings(c).select("root", "path"), "findings")  # two steps look at them
    status = c.where("substring(md5(path), 1, 1) between '0' and '7'").select("root", "path", F.lit("modified").alias("status"))
    near = repositories.nearest_repository(found.select("root", "path"), entries_of(c))
    return secrets.with_git_status(found, status, nearest=near).select("path", "git_status")


def scan_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return secrets.scan_job(c, entries_of(c))["summary"].drop("root")


def scan_job_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    status = c.select("root", "path").limit(0).withColumn("status", F.lit("modified"))
    return secrets.scan_job(c, entries_of(c), status)["findings"].select("path", "risk", "git_status", "position")


def routes_in_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return routing.with_in_trash(routing.routes(c), trash.trash_dirs(R.stored_entries(spark, sf_dir), R.ALL)).select("path", "route", "in_trash")


def skipped_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.skipped_dirs(entries(spark, sf_dir)).drop("root")


def lifecycle_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every choice of phases, where directories named dist can't be removed."""
    e = R.stored_entries(spark, sf_dir)
    found = trash.trash_dirs(e)
    errors = found.where("pattern_name = 'dist'").select("root", F.lit("trash").alias("stage"), F.lit("in use").alias("message"))
    choices = [(bool(on & 1), bool(on & 2), bool(on & 4)) for on in range(8)]
    plans = routing.lifecycle_plans(R.stored_routes(spark, sf_dir), found, choices, errors)
    rows = plans.join(routing.plan_success(plans, "choice"), ["root", "choice"])
    return rows.select(F.col("choice").alias("switches"), "stage", "files", "bytes", "message", "ok", "success")


def stash_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = routing.stash_plan(corpus(spark, sf_dir))
    return plan.groupBy("risk").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps, ids, labels and paths of a run for every order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    key = F.col("o_orderkey").cast("string")
    ts, id_ = P.utc_stamp(F.col("at")), P.short_id(key)
    store = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/store/").otherwise("/stored/"), key)
    return o.select(
        "o_orderkey", ts.alias("stamp"), id_.alias("id"), P.mib_label(F.col("o_orderkey") * 1000).alias("mib"), P.store_relative(store, "/store").alias("relative"),
        P.pack_path(key, ts).alias("pack"), P.pack_path(key, ts, F.when(F.col("o_orderkey") % 3 == 0, "own.tar.zst")).alias("named"),
        P.stash_path(key, ts, id_).alias("stash"), P.manifest_path(key, ts, id_).alias("manifest"),
    )


def root_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the corpus asked for as a root: directories are fine, files are not, unlisted ones are missing."""
    e = entries(spark, sf_dir)
    own = e.select(F.col("path").alias("root"), F.lit("").alias("path"), "kind")
    asked = own.select("root").unionByName(own.select(F.concat("root", F.lit(".gone")).alias("root")))
    return sinks.check_roots(own, asked)


def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of directories that hold the name of a file already get an id."""
    e = entries(spark, sf_dir)
    planned = e.where("kind = 'dir' and size(parts) > 0").select(F.concat_ws("-", "parts").alias("name")).distinct()
    return sinks.free_names(planned, planned.where("length(name) % 2 = 0"), "0a1b2c3d")


def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).where("kind = 'dir'")
    return e.select("path", sinks.result_key(F.col("path"), F.size("parts"), F.lit("default")).alias("key"))


def status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of every project: one field a file, renames followed by the old name."""
    c = corpus(spark, sf_dir).select("root", F.split("path", "/")[0].alias("repo"), "path")
    code = F.substring(F.md5("path"), 1, 1)
    field = F.when(code < "6", F.concat(F.lit(" M "), "path")).when(code < "a", F.concat(F.lit("?? "), "path")).otherwise(F.concat(F.lit("R  "), "path", F.lit("\0"), F.concat(F.lit("?? old/"), "path")))
    raw = c.groupBy("root", "repo").agg(F.array_join(F.array_sort(F.collect_list(field)), "\0").alias("raw"))
    return repositories.parse_status(raw).drop("root")


_QUERIES = [
    filename_scan, filename_scan_high, findings_in_order, repeats_in_order, repeated_paths, candidates_in_order, trash_in_order, stash_in_order,
    findings_custom_skips, findings_no_skips, candidates_custom_skips, findings_own_rules, frameworks_own_rules, stacks_without_listing,
    binary_contents, contents_after_filters, scoped_findings, git_status_outside, scan_job, scan_job_findings, routes_in_trash, skipped_dirs,
    lifecycle_switches, stash_totals, run_names, root_problems, free_names, result_keys, status_records,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def _skip_custom(parts: str) -> str:
    return f"({R._SKIP.format(parts)} or len(list_filter({parts}, lambda c: c = 'src' or ends_with(c, 'ui') or (starts_with(c, '.') and length(c) > 1))) > 0)"


def _walk(where: str) -> str:
    """The base with another walk: the files that are scanned."""
    old = f"scanned as (select * from reach where len(parts) <= 6 and not {R._SKIP.format('parts[1:-2]')})"
    assert old in R._BASE
    return R._BASE.replace(old, f"scanned as (select * from reach where {where})")


def _own_base() -> str:
    names = R._values([(i, k, p, R.risk_rank(r), rule, label) for i, (k, p, r, rule, label) in enumerate(OWN_NAMES)])
    marks = R._values([(i, rule, k, p, R.risk_rank(r), label) for i, (rule, k, p, r, label) in enumerate(OWN_MARKERS)])
    hits = {
        "contains": lambda p: f"list_transform(range(1, len(string_split(l, {R._q(p)}))), lambda k: {R._q(p)})",
        "regex": lambda p: f"regexp_extract_all(l, {R._q(p)})", "prefix": lambda p: R._regex_hits("", "prefix", p),
    }
    each = " union all ".join(f"select root, path, 1 as skind, line, {i} as ord, cast(k as integer) as occ, h[k] as value from (select root, path, line, {hits[k_](p)} as h from lines), unnest(range(1, len(h) + 1)) as t(k)" for i, (_, k_, p, _, _) in enumerate(OWN_MARKERS))
    base = R._BASE.replace(R._FN, names).replace(R._CM, marks)
    a, b = base.index("hits0 as ("), base.index("hits1 as (")
    return base[:a] + f"hits0 as ({each}),\n" + base[b:]


_F = """kept as (select * from masks where true),
f as (select root, path, max(risk) as r, arg_min(label, (skind, line, ord, occ)) as label, string_agg(rule, '|' order by skind, line, ord, occ) as rules,
       arg_min(masked, (-risk, line, ord, occ)) filter (where skind = 1) as masked, arg_min(value_hash, (-risk, line, ord, occ)) filter (where skind = 1) as value_hash
     from kept group by root, path)"""
_BEST = f"best as (select root, path, max(risk) as r, arg_min(rule, (-risk, ord)) as rule, arg_min(label, (-risk, ord)) as label from names0 semi join scanned using (root, path) group by root, path) select path, {R._RISK}[r + 1] as risk, rule, label from best"
_REP = "rep as (select value_hash, arg_min(masked, string_split(path, '/')) as masked, max(r) as r, count(*) as count from f where value_hash is not null group by root, value_hash having count(*) >= 2)"
_POS = "row_number() over (order by {0})"
_PARTS = "string_split(path, '/')"


def oracle_sql() -> dict[str, str]:
    base = f"{R._BASE}, {_F}"
    cand = f"{R._ENTRIES}, {R._C}".replace("arg_min_null(hint, (level, ord))", "list(hint order by level, ord)[1]")
    custom = _skip_custom("parts[1:-2]")
    cand_custom = cand.replace(f"len(parts) - 1 <= 6 and not {R._SKIP.format('parts[1:-2]')}", f"len(parts) - 1 <= 6 and not {custom}")
    assert cand_custom != cand
    stages = f"""st as ({R._STAGE.format(0, 'stash', "routed where route = 'stash'")} union all {R._STAGE.format(1, 'trash', 'trash')} union all {R._STAGE.format(2, 'pack', "routed where route = 'pack'")})"""
    label = "case stage when 'stash' then case when files = 0 then 'nothing to stash' else 'would stash ' || files || ' files' end when 'trash' then 'found ' || files || ' directories' else 'would pack project' end"
    stamp = "strftime(o_orderdate, '%Y%m%dT%H%M%SZ')"
    month = "strftime(o_orderdate, '%Y/%m')"
    id_ = "left(sha256(cast(o_orderkey as varchar)), 8)"
    return {
        "filename_scan": f"{R._BASE}, {_BEST}",
        "filename_scan_high": f"{R._BASE}, {_BEST} where r >= 2",
        "findings_in_order": f"{base} select path, {R._RISK}[r + 1] as risk, label, left(value_hash, 4) || '…' as preview, {_POS.format(_PARTS)} as by_path, {_POS.format('r desc, ' + _PARTS)} as by_risk from f",
        "repeats_in_order": f"{base}, {_REP} select value_hash, masked, {R._RISK}[r + 1] as risk, count, {_POS.format('r desc, value_hash')} as position from rep",
        "repeated_paths": f"{base}, {_REP} select value_hash, path from f semi join rep using (value_hash)",
        "candidates_in_order": f"{cand} select path, {_POS.format('case when path = chr(39) || chr(39) then [] else ' + _PARTS + ' end')} as position from cand",
        "trash_in_order": f"{R._ENTRIES}, {R._TR.format(rows=R._TRASH)} select path, printf('%.1f MiB', size_bytes / 1048576.0) as size, {_POS.format(_PARTS)} as position from trash",
        "stash_in_order": f"{R._findings_sql('risk >= 2', '')} select path, {R._RISK}[r + 1] as risk, cast(strlen(text) as bigint) as size_bytes, {_POS.format(_PARTS)} as position from f join corpus using (root, path)",
        "findings_custom_skips": f"{_walk(f'len(parts) <= 6 and not {custom}')}, {_F} select path, {R._RISK}[r + 1] as risk from f",
        "findings_no_skips": f"{_walk('len(parts) <= 64')}, {_F} select path, {R._RISK}[r + 1] as risk from f",
        "candidates_custom_skips": f"{cand_custom} select path, is_git_repo from cand",
        "findings_own_rules": f"{_own_base()}, {_F} select path, {R._RISK}[r + 1] as risk, rules, value_hash from f",
        "frameworks_own_rules": f"""{cand}, n as (select root, array_to_string(parts[1:-2], '/') as path, parts[-1] as n from entries where kind = 'file'
            union all select root, array_to_string(parts[1:-3], '/'), parts[-2] || '/' || parts[-1] from entries where kind = 'file' and len(parts) >= 2),
            s as (select root, path, bool_or(n in ('kubeconfig', 'id_rsa')) as a, bool_or(n = 'config/app.cfg') as b, bool_or(starts_with(n, 'main.') and length(n) > 5) as c from n group by root, path)
            select path, concat_ws('|', case when a and list_has_any(ml, ['package.json', 'Cargo.toml']) then 'Deployed' end, case when b and list_has_any(ml, ['Cargo.toml', 'pyproject.toml']) then 'Config' end,
            case when c and list_contains(ml, 'Makefile') then 'Any' end) as frameworks from cand left join s using (root, path)""",
        "stacks_without_listing": f"{cand} select path, language, coalesce(language, '-') as stack from cand",
        "binary_contents": f"""with {R.CORPUS_SQL}, b as (select path, text, (length(text) % 10) * 1000 as n from corpus),
            s as (select path, text, n, case when n % 2000 <> 0 then strlen(text) + 1 <= 1048576 else 2 * n >= 8192 and 2 * n + 1 + strlen(text) <= 1048576 end as scanned from b)
            select path, scanned, case when scanned then length(text) + 1 + case when n % 2000 = 0 then n else 0 end end as n_chars,
                   case when scanned then case when n % 2000 <> 0 then chr(65533) else 'é' end end as first from s""",
        "contents_after_filters": f"{R._BASE} select path, cast(strlen(text) as bigint) as size_bytes from scanned where strlen(text) between 1 and 2000",
        "scoped_findings": f"""{_walk("len(parts) <= 7 and parts[1] = 'p04' and not " + R._SKIP.format('parts[2:-2]'))}, {_F} select root || '/p04' as root, substr(path, 5) as path, {R._RISK}[r + 1] as risk from f""",
        "git_status_outside": f"""{base}, repo as (select distinct root, array_to_string(parts[1:-2], '/') as repo from entries where parts[-1] = '.git'),
            held as (select distinct f.root, f.path from f join repo on f.root = repo.root and (repo = '' or starts_with(f.path, repo || '/')))
            select f.path, case when h.path is null then 'unknown' when left(md5(f.path), 1) between '0' and '7' then 'modified' else 'tracked' end as git_status from f left join held h using (root, path)""",
        "scan_job": f"{base}, {_REP} select (select count(*) from scanned) as files_scanned, (select count(*) from f) as findings, (select count(*) from rep) as repeated, case when (select max(r) from f) >= 3 then 2 else 0 end as exit_code",
        "scan_job_findings": f"""{base}, repo as (select distinct root, array_to_string(parts[1:-2], '/') as repo from entries where parts[-1] = '.git'),
            held as (select distinct f.root, f.path from f join repo on f.root = repo.root and (repo = '' or starts_with(f.path, repo || '/')))
            select f.path, {R._RISK}[r + 1] as risk, case when h.path is null then 'unknown' else 'tracked' end as git_status, {_POS.format("string_split(f.path, '/')")} as position from f left join held h using (root, path)""",
        "routes_in_trash": f"{R._BASE}, {R._ROUTE.format(stash='true')}, {R._TR.format(rows=R._TRASH)} select path, route, exists (select 1 from outerm o where o.root = routed.root and starts_with(routed.path, o.path || '/')) as in_trash from routed",
        "skipped_dirs": f"{R._ENTRIES} select parts[1] as project, path from entries where kind = 'dir' and len(parts) >= 2 and {R._SKIP.format('parts[-1:]')} and not {R._SKIP.format('parts[2:-2]')}",
        "lifecycle_switches": f"""{R._BASE}, {R._ROUTE.format(stash='true')}, {R._TR.format(rows=R._DEFAULT_TRASH)}, {stages},
            e as (select count(*) > 0 as bad from trash where pattern_name = 'dist'),
            w as (select s as switches, stage, files, bytes, {label} as m, (s >> ord) & 1 = 1 as is_on, stage = 'trash' and bad as failed from st, e, unnest(range(0, 8)) as t(s))
            select cast(switches as integer) as switches, stage, case when is_on then files else 0 end as files, cast(case when is_on then bytes else 0 end as bigint) as bytes,
                   case when not is_on then 'disabled' when failed then 'in use' else m end as message, not is_on or not failed as ok, bool_and(not is_on or not failed) over (partition by switches) as success from w""",
        "stash_totals": f"{R._findings_sql('risk >= 2', '')} select {R._RISK}[r + 1] as risk, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes from f join corpus using (root, path) group by r",
        "run_names": f"""select o_orderkey, {stamp} as stamp, {id_} as id, printf('%.1f MiB', o_orderkey * 1000 / 1048576.0) as mib,
            case when o_orderkey % 2 = 0 then cast(o_orderkey as varchar) else '/stored/' || o_orderkey end as relative, 'packs/' || {month} || '/' || o_orderkey || '__' || {stamp} || '.tar.zst' as pack,
            'packs/' || {month} || '/' || case when o_orderkey % 3 = 0 then 'own.tar.zst' else o_orderkey || '__' || {stamp} || '.tar.zst' end as named,
            'secrets/' || {month} || '/' || o_orderkey || '__' || {id_} || '__secrets.age' as stash, 'manifests/' || {month} || '/' || o_orderkey || '__' || {stamp} || '__' || {id_} || '.json' as manifest from orders""",
        "root_problems": f"{R._ENTRIES} select path as root, 'not_a_directory' as problem from entries where kind = 'file' union all select path || '.gone', 'missing' from entries",
        "free_names": f"{R._ENTRIES}, d as (select distinct array_to_string(parts, '-') as name from entries where kind = 'dir' and len(parts) > 0) select name, case when length(name) % 2 = 0 then name || '__0a1b2c3d' else name end as final from d",
        "result_keys": f"{R._ENTRIES} select path, sha256(path || chr(0) || len(parts) || chr(0) || 'default') as key from entries where kind = 'dir'",
        "status_records": f"{R._ENTRIES} select split_part(path, '/', 1) as repo, path, case when left(md5(path), 1) < '6' then 'modified' when left(md5(path), 1) < 'a' then 'untracked' else 'staged' end as status from corpus",
    }
