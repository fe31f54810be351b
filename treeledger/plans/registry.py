"""Registered queries of the source-tree operators, over the derived corpus, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.rules import CONTENT_MARKERS, FILENAME_PATTERNS, LANGUAGE_LEVELS, MARKERS, SKIP_EXACT, TRASH, risk_rank
from treeledger.operators import projects, repositories, routing, secrets, trash
from treeledger.sources.corpus import CORPUS_SQL, corpus, entries, entries_of
from treeledger.sources.store import written

TS = "20260102T030405Z"


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    p = F.col("parts")
    last = F.element_at(F.concat(F.array(F.lit("")), p), -1)
    parent = P.join_parts(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))
    return e.select("path", "kind", last.alias("name"), parent.alias("parent"), F.size(p).alias("depth"), F.array_join(P.ancestors(p), "|").alias("ancestors"))


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.array(F.lit("p04"), F.lit("src"))
    rel = P.relative(F.col("parts"), root)
    return entries(spark, sf_dir).select("path", P.is_under(F.col("parts"), root).alias("under"), rel.alias("rel")).where("under")


def project_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    s = P.slug(F.col("url"))
    ts = F.lit(TS)
    return pages.select("page_id", s.alias("slug"), P.dated("packs", F.concat(s, F.lit("__"), ts, F.lit(".tar.zst")), ts).alias("pack"), P.valid_fragment(F.col("url")).alias("valid"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).where("kind = 'file'")
    return e.select("path", P.human_size(F.col("size_bytes")).alias("size"))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).where("kind = 'dir' and size(parts) > 0")
    return e.select("path", P.skipped_dir(F.element_at("parts", -1), custom=("*ui", "deploy"), hidden=True).alias("reason"), P.skipped(F.col("parts"), F.lit("dir")).alias("skipped"))


def eligible_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scanned_files(corpus(spark, sf_dir))
    return rows.select("path", F.octet_length("text").cast("long").alias("size_bytes"), secrets.eligible(F.col("text")).alias("eligible"))


def filename_matches_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scanned_files(corpus(spark, sf_dir)).select("path", F.explode(secrets.name_sources(F.col("name"))).alias("s"))
    return rows.select("path", "s.rule", "s.label", secrets.risk_name(F.col("s.risk")).alias("risk"))


def content_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.content_hits(corpus(spark, sf_dir)).drop("root")


def _flat(found: DataFrame) -> DataFrame:
    return found.select("path", "risk", "label", F.array_join("labels", "|").alias("labels"), F.array_join("rules", "|").alias("rules"), "masked", "value_hash", "original_len")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(secrets.findings(corpus(spark, sf_dir)))


def findings_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(secrets.findings(corpus(spark, sf_dir), min_risk="Critical"))


def findings_names_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(secrets.findings(corpus(spark, sf_dir), scan_content=False)).drop("masked", "value_hash", "original_len")


def files_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned_files(corpus(spark, sf_dir)).agg(F.count("*").alias("files_scanned"))


def risk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.risk_gates(secrets.findings(corpus(spark, sf_dir)))


def repeated_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = secrets.repeated_secrets(secrets.findings(corpus(spark, sf_dir)))
    return r.select("value_hash", "masked", "risk", F.array_join("paths", "|").alias("paths"), "count")


def git_status_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    found = secrets.findings(c)
    code = F.substring(F.md5("path"), 1, 1)
    xy = F.when(code.between("0", "2"), "??").when(code.between("3", "5"), " M").when(code.between("6", "7"), "A ").when(code == "8", "R ").when(code == "9", " D").when(code == "a", "!!").when(code == "b", "  ").when(code == "c", "TT")
    status = c.select("root", "path", xy.alias("xy")).where("xy is not null").select("root", "path", secrets.git_status_of(F.col("xy")).alias("status"))
    return secrets.with_git_status(found, status).select("path", "risk", "git_status")


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing as a table: jobs that look at it several times read narrow rows instead of the texts."""
    return written(entries(spark, sf_dir), "entries")


def stored_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(routing.routes(corpus(spark, sf_dir)), "routes")


def _stack(found: DataFrame) -> DataFrame:
    return found.select("path", "name", F.array_join(F.transform("hits", lambda h: h["name"]), "|").alias("hits"), "is_git_repo")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(projects.candidates(entries(spark, sf_dir)))


def candidates_no_git_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(projects.candidates(entries(spark, sf_dir), accept_git_only=False))


def candidates_extra_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(projects.candidates(entries(spark, sf_dir), extra=(("file", "README.md", "Docs"),)))


def project_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projects.projects(stored_entries(spark, sf_dir))
    return p.select("path", "name", "language", F.array_join("frameworks", "|").alias("frameworks"), F.array_join("markers", "|").alias("markers"), projects.stack_label().alias("stack"), "is_git_repo", "size_bytes")


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored_entries(spark, sf_dir)
    return projects.scan_report(projects.project_sizes(projects.candidates(e), e)).drop("root")


ALL = tuple(s for s, _ in TRASH)


def trash_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trash.trash_dirs(stored_entries(spark, sf_dir), ALL).drop("root")


def trash_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trash.by_strategy(trash.trash_dirs(stored_entries(spark, sf_dir))).drop("root")


def stash_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.stash_plan(corpus(spark, sf_dir)).drop("root")


def pack_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routes(corpus(spark, sf_dir), stash=False).drop("root")


def lifecycle_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routes(corpus(spark, sf_dir)).drop("root")


def pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.pack_stats(routing.routes(corpus(spark, sf_dir))).drop("root")


def lifecycle_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.lifecycle_stages(stored_routes(spark, sf_dir), trash.trash_dirs(stored_entries(spark, sf_dir))).drop("root", "ord")


def depth_kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where("kind = 'file' and size(parts) between 1 and 4").select("path", F.size("parts").alias("depth"), "size_bytes")


def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = projects.candidates(entries(spark, sf_dir)).select("path", P.slug(F.concat_ws("/", "root", "path")).alias("slug"))
    ts = F.lit(TS)
    return made.select("path", P.dated("packs", F.concat("slug", F.lit(f"__{TS}.tar.zst")), ts).alias("pack"), P.dated("secrets", F.concat("slug", F.lit(f"__{TS}.age")), ts).alias("stash"))


def nearest_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return repositories.nearest_repository(c, entries_of(c)).drop("root")


def stash_only_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    e = entries_of(c)
    asked = e.where("size(parts) > 0").select("root", "path")
    gone = e.where("kind = 'file'").select("root", F.concat("path", F.lit(".gone")).alias("path"))
    above = e.where("kind = 'dir'").select("root", F.concat(F.lit("../"), "path").alias("path"))
    return routing.stash_only(asked.unionByName(asked).unionByName(gone).unionByName(above), e, c).drop("root")


_QUERIES = [
    depth_kind_filter, artifact_paths, nearest_repository, stash_only_files,
    path_parts, relative_paths, project_slugs, human_sizes, skip_reasons, eligible_contents, filename_matches_all, content_hits,
    findings, findings_critical, findings_names_only, files_scanned, risk_gate, repeated_secrets, git_status_join,
    candidates, candidates_no_git_only, candidates_extra_marker, project_table, scan_report, trash_dirs, trash_by_strategy,
    stash_plan, pack_routes, lifecycle_routes, pack_stats, lifecycle_stages,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def _q(s) -> str:
    return "NULL" if s is None else str(s) if isinstance(s, int) else "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)


_RISK = "['Low', 'Medium', 'High', 'Critical']"
_SKIP = "(list_has_any({0}, [" + ", ".join(map(_q, SKIP_EXACT)) + "]) or len(list_filter({0}, lambda c: ends_with(c, '.egg-info'))) > 0)"
_FN = _values([(i, k, p, risk_rank(r), rule, label) for i, (k, p, r, rule, label) in enumerate(FILENAME_PATTERNS)])
_CM = _values([(i, rule, k, p, risk_rank(r), label) for i, (rule, k, p, r, label) in enumerate(CONTENT_MARKERS)])
_MARK = _values([(i, k, n, h, next((j for j, g in enumerate(LANGUAGE_LEVELS) if n in g), 999)) for i, (k, n, h) in enumerate(MARKERS)])
_TRASH = _values([(s, i, p, j) for i, (s, ps) in enumerate(TRASH) for j, p in enumerate(ps)])


def _regex_hits(rule: str, k: str, p: str) -> str:
    """A list of the hits in line l. A prefix marker: split at the literal, and the token at the head of each rest, which
    is put together again with the literal, since tokens may overlap."""
    if k == "regex":
        return f"regexp_extract_all(l, {_q(p)})"
    tail = f"array_to_string((string_split(l, {_q(p)}))[k:], {_q(p)})"
    return f"list_transform(range(2, len(string_split(l, {_q(p)})) + 1), lambda k: {_q(p)} || regexp_extract({tail}, '^[A-Za-z0-9_-]*'))"


_BASE = f"""
with {CORPUS_SQL},
fn(ord, kind, pattern, risk, rule, label) as (values {_FN}),
cm(ord, rule, kind, pattern, risk, label) as (values {_CM}),
reach as (select root, path, text, parts, parts[-1] as name from (select *, string_split(path, '/') as parts from corpus)),
scanned as (select * from reach where len(parts) <= 6 and not {_SKIP.format('parts[1:-2]')}),
names0 as (select r.root, r.path, 0 as skind, 0 as line, ord, 0 as occ, risk, rule, label, cast(null as varchar) as value
          from reach r join fn on case kind when 'exact' then name = pattern when 'prefix' then starts_with(name, pattern)
          when 'suffix' then ends_with(name, pattern) else contains(name, pattern) end),
lines as (select root, path, i as line, ls[i] as l from (select root, path, string_split(text, chr(10)) as ls from reach
          where strlen(text) between 1 and 1048576 and not contains(text, chr(0))), unnest(range(1, len(ls) + 1)) as t(i)),
hits0 as ({" union all ".join(f"select root, path, 1 as skind, line, {i} as ord, cast(k as integer) as occ, h[k] as value from (select root, path, line, {_regex_hits(rule, k, p)} as h from lines), unnest(range(1, len(h) + 1)) as t(k)" for i, (rule, k, p, _, _) in enumerate(CONTENT_MARKERS))}),
hits1 as (select h.root, h.path, skind, line, h.ord, occ, risk, rule, label, value from hits0 h join cm using (ord)),
src0 as (select * from names0 union all select * from hits1),
src as (select s.* from src0 s semi join scanned using (root, path)),
masks as (select *, case when value is null then null when strlen(value) <= 8 or length(value) <= 6 then '****' else left(value, 4) || '…' || right(value, 2) end as masked,
          sha256(value) as value_hash, cast(strlen(value) as integer) as original_len from src)
"""


def _findings_sql(where: str, tail: str) -> str:
    return f"""{_BASE},
kept as (select * from masks where {where}),
f as (select root, path, max(risk) as r, arg_min(label, (skind, line, ord, occ)) as label,
       string_agg(label, '|' order by skind, line, ord, occ) as labels, string_agg(rule, '|' order by skind, line, ord, occ) as rules,
       arg_min(masked, (-risk, line, ord, occ)) filter (where skind = 1) as masked,
       arg_min(value_hash, (-risk, line, ord, occ)) filter (where skind = 1) as value_hash,
       arg_min(original_len, (-risk, line, ord, occ)) filter (where skind = 1) as original_len
     from kept group by root, path)
{tail}"""


_FLAT = f"select path, {_RISK}[r + 1] as risk, label, labels, rules, masked, value_hash, original_len from f"

_ENTRIES = f"with {CORPUS_SQL}"
_CAND = f"""
mk(ord, mkind, mname, hint, level) as (values {{marks}}),
hit as (select root, array_to_string(parts[1:-2], '/') as path, ord, mname, hint, level, kind from entries join mk on kind = mkind and parts[-1] = mname
        where len(parts) >= 1 and len(parts) - 1 <= 6 and not {_SKIP.format('parts[1:-2]')}),
cand as (select root, path, coalesce(nullif(string_split(path, '/')[-1], ''), root) as name, string_agg(mname, '|' order by ord) as hits,
         bool_or(mname = '.git') as is_git_repo, arg_min_null(hint, (level, ord)) as language,
         array_to_string(list_sort(list_distinct(list(mname))), '|') as markers, list(mname) as ml, count(*) filter (where not (mname = '.git' and kind = 'dir')) as others from hit group by root, path)"""
_C = _CAND.format(marks=_MARK)
_C2 = _CAND.format(marks=_MARK + f", ({len(MARKERS)}, 'file', 'README.md', 'Docs', 999)")
_CSEL = "select path, name, hits, is_git_repo from cand"
_SIZES = f"""
sizes as (select c.root, c.path, cast(coalesce(sum(e.size_bytes) filter (where len(e.parts) - c.d <= 6 and not {_SKIP.format('e.parts[c.d + 1:-2]')}), 0) as bigint) as size_bytes
          from (select *, case when path = '' then 0 else len(string_split(path, '/')) end as d from cand) c
          left join entries e on e.root = c.root and e.kind = 'file' and (c.path = '' or starts_with(e.path, c.path || '/'))
          group by c.root, c.path)"""
_FW = """
names as (select root, array_to_string(parts[1:-2], '/') as path, parts[-1] as n from entries where kind = 'file' and len(parts) >= 1
          union all select root, array_to_string(parts[1:-3], '/'), 'config/application.rb' from entries where kind = 'file' and len(parts) >= 2 and parts[-1] = 'application.rb' and parts[-2] = 'config'),
shown as (select root, path, min(case when n in ('next.config.js', 'next.config.mjs', 'next.config.ts') then 1 end) as nx, min(case when starts_with(n, 'nuxt.config.') and length(n) > 12 then 1 end) as nu,
          min(case when n = 'angular.json' then 1 end) as an, min(case when starts_with(n, 'vite.config.') and length(n) > 12 then 1 end) as vi, min(case when n = 'deno.json' then 1 end) as de,
          min(case when n = 'manage.py' then 1 end) as dj, min(case when n = 'build.sbt' then 1 end) as sb, min(case when n = 'config/application.rb' then 1 end) as ra from names group by root, path),
fw as (select c.*, concat_ws('|', case when nx = 1 and list_contains(ml, 'package.json') then 'Next.js' end, case when nu = 1 and list_contains(ml, 'package.json') then 'Nuxt' end,
       case when an = 1 and list_contains(ml, 'package.json') then 'Angular' end, case when vi = 1 and list_contains(ml, 'package.json') then 'Vite' end, case when de = 1 and list_contains(ml, 'package.json') then 'Deno' end,
       case when dj = 1 and list_has_any(ml, ['pyproject.toml', 'setup.py', 'requirements.txt']) then 'Django' end, case when sb = 1 and list_has_any(ml, ['pom.xml', 'build.gradle', 'build.gradle.kts']) then 'sbt' end,
       case when ra = 1 and list_contains(ml, 'Gemfile') then 'Rails' end) as frameworks from cand c left join shown using (root, path))"""
_TR = f"""
tp(strategy, so, pattern, po) as (values {{rows}}),
th as (select root, path, parts, arg_min(strategy, (so, po)) as strategy, arg_min(pattern, (so, po)) as pattern_name from entries
       join tp on case when starts_with(pattern, '*') then ends_with(parts[-1], pattern[2:]) else parts[-1] = pattern end
       where kind = 'dir' and len(parts) >= 2 and len(parts) - 1 <= 6 group by root, path, parts),
outerm as (select * from th a where not exists (select 1 from th b where a.root = b.root and starts_with(a.path, b.path || '/'))),
trash as (select o.root, o.parts[1] as project, o.path, strategy, pattern_name, cast(coalesce(sum(e.size_bytes), 0) as bigint) as size_bytes
          from outerm o left join entries e on e.root = o.root and e.kind = 'file' and starts_with(e.path, o.path || '/') group by all)"""
_DEFAULT_TRASH = _values([(s, i, p, j) for i, (s, ps) in enumerate(TRASH[:3]) for j, p in enumerate(ps)])
_ROUTE = f"""
top as (select root, path, max(risk) filter (where skind = 0) as nr, max(risk) filter (where skind = 1) as cr from src0 group by root, path),
routed as (select r.root, r.parts[1] as project, r.path, cast(strlen(r.text) as bigint) as size_bytes,
  case when {_SKIP.format('r.parts[2:-2]')} then 'pruned' when {{stash}} and len(r.parts) <= 6 and greatest(coalesce(nr, -1), coalesce(cr, -1)) >= 2 then 'stash'
  when len(r.parts) - 1 > 64 then 'too_deep' when nr >= 2 then 'deny_name' when cr >= 3 then 'deny_content' else 'pack' end as route
  from reach r left join top using (root, path))"""
_SIZE = "case when size_bytes >= 1073741824 then printf('%.1f GiB', size_bytes / 1073741824.0) when size_bytes >= 1048576 then printf('%.1f MiB', size_bytes / 1048576.0) when size_bytes >= 1024 then printf('%.1f KiB', size_bytes / 1024.0) else size_bytes || ' B' end"
_STAGE = "select {0} as ord, '{1}' as stage, count(*) as files, cast(coalesce(sum(size_bytes), 0) as bigint) as bytes from {2}"


def oracle_sql() -> dict[str, str]:
    slug = "coalesce(nullif(left(regexp_replace(regexp_replace(coalesce(list_filter(regexp_split_to_array(url, '[/\\\\]'), lambda x: x <> '')[-1], ''), '\\s', '-', 'g'), '[^A-Za-z0-9._-]', '', 'g'), 80), ''), 'project')"
    f = _findings_sql("true", "")
    cand = lambda c: c.replace("arg_min_null(hint, (level, ord))", "list(hint order by level, ord)[1]")
    last = "coalesce(nullif(string_split(path, '/')[-1], ''), root)"
    return {
        "depth_kind_filter": f"{_ENTRIES} select path, cast(len(parts) as integer) as depth, size_bytes from entries where kind = 'file' and len(parts) between 1 and 4",
        "artifact_paths": cand(f"{_ENTRIES}, {_C}, s as (select path, left(regexp_replace({last}, '[^A-Za-z0-9._-]', '', 'g'), 80) as slug from cand) select path, 'packs/2026/01/' || slug || '__{TS}.tar.zst' as pack, 'secrets/2026/01/' || slug || '__{TS}.age' as stash from s"),
        "nearest_repository": f"{_ENTRIES}, r as (select distinct root, array_to_string(parts[1:-2], '/') as repo from entries where parts[-1] = '.git') select c.path, arg_max(r.repo, length(r.repo)) as repo from corpus c left join r on c.root = r.root and (r.repo = '' or starts_with(c.path, r.repo || '/')) group by c.root, c.path",
        "stash_only_files": f"{_BASE}, asked as (select root, path from entries where len(parts) > 0 union select root, path || '.gone' from entries where kind = 'file' union select root, '../' || path from entries where kind = 'dir'), top as (select root, path, max(risk) as r from src0 group by root, path) select a.path, case when starts_with(a.path, '../') then 'outside' when e.kind is null then 'missing' when e.kind <> 'file' then 'not_a_file' when coalesce(r, -1) < 2 then 'below_risk' else 'selected' end as state, case when r >= 2 then {_RISK}[r + 1] end as risk, case when e.kind = 'file' then e.size_bytes end as size_bytes from asked a left join entries e using (root, path) left join top using (root, path)",
        "path_parts": f"{_ENTRIES} select path, kind, coalesce(parts[-1], '') as name, array_to_string(parts[1:-2], '/') as parent, cast(len(parts) as integer) as depth, array_to_string(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/')), '|') as ancestors from entries",
        "relative_paths": f"{_ENTRIES} select path, true as under, array_to_string(parts[3:], '/') as rel from entries where parts[1:2] = ['p04', 'src']",
        "project_slugs": f"select page_id, {slug} as slug, 'packs/2026/01/' || {slug} || '__{TS}.tar.zst' as pack, not (url in ('', '.', '..') or contains(url, '/') or contains(url, '\\') or contains(url, chr(0))) as valid from pages",
        "human_sizes": f"{_ENTRIES} select path, {_SIZE} as size from entries where kind = 'file'",
        "skip_reasons": f"{_ENTRIES} select path, case when {_SKIP.format('parts[-1:]')} then 'DefaultDirName' when ends_with(parts[-1], 'ui') or parts[-1] = 'deploy' then 'CustomPattern' when starts_with(parts[-1], '.') then 'Hidden' end as reason, {_SKIP.format('parts')} as skipped from entries where kind = 'dir' and len(parts) > 0",
        "eligible_contents": f"{_BASE} select path, cast(strlen(text) as bigint) as size_bytes, strlen(text) between 1 and 1048576 and not contains(text, chr(0)) as eligible from scanned",
        "filename_matches_all": f"{_BASE} select path, rule, label, {_RISK}[risk + 1] as risk from src where skind = 0",
        "content_hits": f"{_BASE} select path, cast(line as integer) as line, rule, {_RISK}[risk + 1] as risk, masked, value_hash from masks where skind = 1",
        "findings": f + _FLAT,
        "findings_critical": _findings_sql("risk >= 3", _FLAT),
        "findings_names_only": _findings_sql("skind = 0", f"select path, {_RISK}[r + 1] as risk, label, labels, rules from f"),
        "files_scanned": f"{_BASE} select count(*) as files_scanned from scanned",
        "risk_gate": f + "select policy, case when policy = 'critical' and m >= 3 or policy = 'high' and m >= 2 then 2 else 0 end as exit_code from (select max(r) as m from f), (values ('ignore'), ('critical'), ('high')) as p(policy)",
        "repeated_secrets": f + f"select value_hash, arg_min(masked, string_split(path, '/')) as masked, {_RISK}[max(r) + 1] as risk, string_agg(path, '|' order by string_split(path, '/')) as paths, count(*) as count from f where value_hash is not null group by root, value_hash having count(*) >= 2",
        "git_status_join": f + f"select path, {_RISK}[r + 1] as risk, case when c between '0' and '2' then 'untracked' when c between '3' and '5' then 'modified' when c between '6' and '8' then 'staged' when c = '9' then 'deleted' when c = 'a' then 'ignored' when c = 'c' then 'unknown' else 'tracked' end as git_status from (select *, left(md5(path), 1) as c from f)",
        "candidates": cand(f"{_ENTRIES}, {_C} {_CSEL}"),
        "candidates_no_git_only": cand(f"{_ENTRIES}, {_C} {_CSEL} where others > 0"),
        "candidates_extra_marker": cand(f"{_ENTRIES}, {_C2} {_CSEL}"),
        "project_table": cand(f"{_ENTRIES}, {_C}, {_SIZES}, {_FW} select path, name, language, frameworks, markers, case when language is null then '-' when frameworks = '' then language else language || ' + ' || replace(frameworks, '|', ' + ') end as stack, is_git_repo, size_bytes from fw join sizes using (root, path)"),
        "scan_report": cand(f"{_ENTRIES}, {_C}, {_SIZES} select count(*) as projects, cast(sum(size_bytes) as bigint) as total_size_bytes, 1 as schema_version from sizes"),
        "trash_dirs": f"{_ENTRIES}, {_TR.format(rows=_TRASH)} select project, path, strategy, pattern_name, size_bytes from trash",
        "trash_by_strategy": f"{_ENTRIES}, {_TR.format(rows=_DEFAULT_TRASH)} select strategy, count(*) as dirs, cast(sum(size_bytes) as bigint) as bytes from trash group by strategy",
        "stash_plan": _findings_sql("risk >= 2", f"select path, {_RISK}[r + 1] as risk, cast(strlen(text) as bigint) as size_bytes from f join corpus using (root, path)"),
        "pack_routes": f"{_BASE}, {_ROUTE.format(stash='false')} select project, path, size_bytes, route from routed",
        "lifecycle_routes": f"{_BASE}, {_ROUTE.format(stash='true')} select project, path, size_bytes, route from routed",
        "pack_stats": f"{_BASE}, {_ROUTE.format(stash='true')} select project, count(*) filter (where route = 'pack') as file_count, count(*) filter (where route in ('deny_name', 'deny_content')) as skipped_secret_files, count(*) filter (where route = 'stash') as stashed, count(*) filter (where route = 'pruned') as pruned, cast(coalesce(sum(size_bytes) filter (where route = 'pack'), 0) as bigint) as pack_bytes from routed group by project",
        "lifecycle_stages": f"{_BASE}, {_ROUTE.format(stash='true')}, {_TR.format(rows=_DEFAULT_TRASH)}, st as ({_STAGE.format(0, 'stash', 'routed where route = ' + chr(39) + 'stash' + chr(39))} union all {_STAGE.format(1, 'trash', 'trash')} union all {_STAGE.format(2, 'pack', 'routed where route = ' + chr(39) + 'pack' + chr(39))}) select stage, files, bytes, case stage when 'stash' then case when files = 0 then 'nothing to stash' else 'would stash ' || files || ' files' end when 'trash' then 'found ' || files || ' directories' else 'would pack project' end as message from st",
    }
