"""Secret scan by file name and by content. Everything about one file is worked out in one row, without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.rules import CONTENT_GATE, CONTENT_MARKERS, FILENAME_PATTERNS, RISKS, risk_rank
from treeledger.operators.ordering import in_order
from treeledger.sources.store import written

MAX_DEPTH = 6
MAX_BYTES = 1 << 20
SNIFF_BYTES = 8192
_SOURCE = "array<struct<kind:int,line:int,ord:int,occ:int,risk:int,rule:string,label:string,value:string>>"


def risk_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), rank + 1)


def name_matches(name: Column, kind: str, pattern: str) -> Column:
    if kind == "exact":
        return name == pattern
    return {"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains}[kind](name, F.lit(pattern))


def _source(kind: int, line, ord_: int, occ, risk: int, rule: str, label: str, value: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), line.cast("int").alias("line"), F.lit(ord_).alias("ord"), occ.cast("int").alias("occ"),
        F.lit(risk).alias("risk"), F.lit(rule).alias("rule"), F.lit(label).alias("label"), value.cast("string").alias("value"),
    )


def name_sources(name: Column, patterns=None) -> Column:
    """One struct for every filename pattern that fits, in table order."""
    zero = F.lit(0)
    each = [F.when(name_matches(name, k, p), _source(0, zero, i, zero, risk_rank(r), rule, label, F.lit(None))) for i, (k, p, r, rule, label) in enumerate(patterns or FILENAME_PATTERNS)]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _java(kind: str, pattern: str) -> tuple[str, int]:
    """Java pattern and group. A prefix marker takes up its literal only and looks ahead for the token, so that tokens
    may overlap; a folded pattern folds in Unicode."""
    if kind == "prefix":
        return rf"\Q{pattern}\E(?=([A-Za-z0-9_-]*))", 1
    if kind == "contains":
        return rf"\Q{pattern}\E", 0
    return pattern.replace("(?i)", "(?iU)"), 0


def check_rules(patterns=None, markers=None) -> None:
    """Refuse rules of the user's own that can't work: unknown kinds or risks, empty literals, broken expressions."""
    for kind, pattern, risk, rule, _ in patterns or ():
        if kind not in ("exact", "prefix", "suffix", "contains") or not pattern:
            raise ValueError(f"filename rule {rule}: kind {kind!r}, pattern {pattern!r}")
        risk_rank(risk)
    for rule, kind, pattern, risk, _ in markers or ():
        if kind not in ("prefix", "contains", "regex") or not pattern:
            raise ValueError(f"content rule {rule}: kind {kind!r}, pattern {pattern!r}")
        risk_rank(risk)
        if kind == "regex":
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"content rule {rule}: {e}") from e


def may_hold(text: Column, markers=None) -> Column:
    """Whether any marker fits somewhere in a text. A hit in a line is one in the text, so what this denies has none; few
    texts pass, and only theirs are cut into lines. With the default markers a lighter expression comes first."""
    some, folded = F.lit(False), []
    for _, kind, pattern, _, _ in markers or CONTENT_MARKERS:
        if kind == "regex":
            folded.append(f"(?:{pattern})" if "(?i)" not in pattern else f"(?iU:{pattern.replace('(?i)', '')})")
        else:
            some = some | F.contains(text, F.lit(pattern))
    some = some | text.rlike("|".join(folded)) if folded else some
    return some if markers else text.rlike(CONTENT_GATE) & some


def content_sources(text: Column, markers=None) -> Column:
    """One struct for every hit of every content marker: line from 1, marker order, occurrence in the line."""
    markers = markers or CONTENT_MARKERS

    def in_line(line: Column, i: Column) -> Column:
        found = []
        for ord_, (rule, kind, pattern, risk, label) in enumerate(markers):
            java, group = _java(kind, pattern)
            hits = F.regexp_extract_all(line, F.lit(java), F.lit(group))
            found.append(F.transform(hits, _hit(i, ord_, rule, kind, pattern, risk, label)))
        return F.concat(*found)

    return F.flatten(F.transform(F.split(text, "\n", -1), in_line))


def _hit(i: Column, ord_: int, rule: str, kind: str, pattern: str, risk: str, label: str):
    def make(x: Column, k: Column) -> Column:
        value = F.concat(F.lit(pattern), x) if kind == "prefix" else x
        return _source(1, i + 1, ord_, k, risk_rank(risk), rule, label, value)

    return make


def masked(value: Column) -> Column:
    """masked, value_hash, original_len: the value is never shown whole."""
    short = (F.octet_length(value) <= 8) | (F.length(value) <= 6)
    return F.struct(
        F.when(short, F.lit("****")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(2)))).alias("masked"),
        F.sha2(value, 256).alias("value_hash"), F.octet_length(value).alias("original_len"),
    )


def scanned_files(contents: DataFrame, max_depth: int = MAX_DEPTH, policy: P.Policy = P.DEFAULT) -> DataFrame:
    """Regular files that the scan reaches: not pruned, not too deep."""
    rows = contents.withColumn("parts", P.parts("path"))
    fits = (F.size("parts") <= P.check_depth(max_depth)) & ~P.skipped(F.col("parts"), F.lit("file"), policy)
    return rows.where(fits).withColumn("name", F.element_at("parts", -1))


def eligible(content: Column) -> Column:
    """1 byte to 1 MiB, and no NUL among the first 8 KiB; content is text or binary."""
    raw = content.cast("binary")
    return F.octet_length(raw).between(1, MAX_BYTES) & (F.instr(F.substring(raw, 1, SNIFF_BYTES).cast("string"), "\0") == 0)


def from_bytes(contents: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Contents (root, path, content binary, others) with text in place of content: what is no UTF-8 is replaced, and what
    the size or the NUL test excludes is null, so that no scan decodes it."""
    fits = eligible(F.col("content")) & (F.octet_length("content") <= max_bytes)
    text = F.when(fits, F.make_valid_utf8(F.col("content").cast("string")))
    return contents.select(*[c for c in contents.columns if c != "content"], text.alias("text"))


def read_eligible(contents: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH, policy: P.Policy = P.DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The contents of the files that a scan looks into, by the listing's kinds, sizes and places: contents of other files
    are dropped by a join on narrow rows before anything is read of them."""
    rows = entries.where((F.col("kind") == "file") & F.col("size_bytes").between(1, max_bytes))
    return contents.join(scanned_files(rows.select("root", "path"), max_depth, policy).select("root", "path"), ["root", "path"], "left_semi")


def scope(contents: DataFrame, project: str) -> DataFrame:
    """Only what lies below a directory, with that as the root: root/project, and paths relative to it."""
    at = F.array(*[F.lit(x) for x in project.split("/") if x])
    parts = P.parts("path")
    rows = contents.where(P.is_under(parts, at) & (F.size(parts) > F.size(at)))
    return rows.withColumn("root", F.concat_ws("/", "root", F.lit(project.strip("/")))).withColumn("path", P.relative(parts, at))


def once(value: Column) -> Column:
    """value as a generated column: what stands above refers to it, and does not work it out again at every use."""
    return F.explode(F.array(value))


def content_sources_of(text: Column, markers=None) -> Column:
    """content_sources of the texts that are eligible and may hold a marker, else none."""
    return F.when(eligible(text) & may_hold(text, markers), content_sources(text, markers).cast(_SOURCE)).otherwise(F.array().cast(_SOURCE))


def sources_of(contents: DataFrame, scan_content: bool = True, patterns=None, markers=None) -> DataFrame:
    """Every row of contents (with parts and name) with sources: all that fits its name and, if asked for, its content, in
    no order. patterns and markers are the user's own rules in place of the default ones."""
    check_rules(patterns, markers)
    found = name_sources(F.col("name"), patterns)
    if scan_content:
        found = F.concat(found.cast(_SOURCE), content_sources_of(F.col("text"), markers))
    return contents.select("*", once(found).alias("sources"))


def scan_secrets(
    contents: DataFrame, min_risk: str = "Low", scan_content: bool = True, max_depth: int = MAX_DEPTH, walk: bool = True,
    policy: P.Policy = P.DEFAULT, patterns=None, markers=None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """root, path, parts, the columns of keep, risk_rank, sources (by kind, line, marker, occurrence) of the files with
    findings; without walk, of pruned and deep files as well."""
    rows = scanned_files(contents, max_depth, policy) if walk else contents.withColumn("parts", P.parts("path")).withColumn("name", F.element_at("parts", -1))
    own = ("root", "path", "parts", *keep)
    rows = sources_of(rows, scan_content, patterns, markers).select(*own, "sources")
    rows = rows.select(*own, F.filter("sources", lambda s: s.risk >= risk_rank(min_risk)).alias("sources")).where(F.size("sources") > 0)
    return rows.select(*own, F.array_max(F.transform("sources", lambda s: s.risk)).alias("risk_rank"), F.array_sort("sources").alias("sources"))


def file_secrets(contents: DataFrame, keep: tuple[str, ...] = (), max_depth: int = MAX_DEPTH, policy: P.Policy = P.DEFAULT, patterns=None, markers=None) -> DataFrame:
    """root, path, the columns of keep, value_hash, masked, risk_rank of every row of contents: its best hit, as findings has
    it, or nulls for a file that is clean, pruned or too deep. One row in, one row out, no shuffle: fit for a stream."""
    rows = contents.withColumn("parts", P.parts("path")).withColumn("name", F.element_at("parts", -1))
    reached = (F.size("parts") <= P.check_depth(max_depth)) & ~P.skipped(F.col("parts"), F.lit("file"), policy)
    rows = sources_of(rows.withColumn("text", F.when(reached, F.col("text"))), True, patterns, markers)
    rows = rows.select("root", "path", *keep, F.array_max(F.transform("sources", lambda s: s.risk)).alias("top"), once(best_content(F.array_sort("sources"))).alias("best"))
    rows = rows.select("root", "path", *keep, "top", once(F.when(F.col("best").isNotNull(), masked(F.col("best.value")))).alias("m"))
    return rows.select("root", "path", *keep, "m.value_hash", "m.masked", F.when(F.col("m").isNotNull(), F.col("top")).alias("risk_rank"))


def best_content(sources: str = "sources") -> Column:
    """The content hit of the highest risk, ties to the first in scan order; null without one."""
    hits = F.filter(sources, lambda s: s.kind == 1)
    return F.aggregate(hits, F.lit(None).cast(_SOURCE[6:-1]), lambda a, s: F.when(a.isNull() | (s.risk > a.risk), s).otherwise(a))


def findings(contents: DataFrame, **options) -> DataFrame:
    """root, path, risk, label, labels, rules, masked, value_hash, original_len. No raw value leaves this function."""
    rows = scan_secrets(contents, **options)
    rows = rows.select("*", once(best_content()).alias("best"))
    rows = rows.select("*", once(F.when(F.col("best").isNotNull(), masked(F.col("best.value")))).alias("m"))
    m = F.col("m")
    return rows.select(
        "root", "path", risk_name(F.col("risk_rank")).alias("risk"), F.element_at("sources", 1)["label"].alias("label"),
        F.transform("sources", lambda s: s.label).alias("labels"), F.transform("sources", lambda s: s.rule).alias("rules"),
        m["masked"].alias("masked"), m["value_hash"].alias("value_hash"), m["original_len"].alias("original_len"),
    )


def content_hits(contents: DataFrame) -> DataFrame:
    """root, path, line, rule, risk, masked, value_hash for every hit."""
    rows = scanned_files(contents).select("root", "path", F.explode(content_sources_of(F.col("text"))).alias("s"))
    m = masked(F.col("s.value"))
    return rows.select("root", "path", "s.line", "s.rule", risk_name(F.col("s.risk")).alias("risk"), m["masked"].alias("masked"), m["value_hash"].alias("value_hash"))


def filename_scan(contents: DataFrame, min_risk: str = "Low", max_depth: int = MAX_DEPTH, policy: P.Policy = P.DEFAULT, patterns=None) -> DataFrame:
    """root, path, risk, rule, label: the best filename match of each file, the highest risk and of equal ones the first in
    the table. Contents are not looked at."""
    check_rules(patterns)
    rows = scanned_files(contents, max_depth, policy).select("root", "path", once(name_sources(F.col("name"), patterns)).alias("s"))
    best = F.aggregate("s", F.lit(None).cast(_SOURCE[6:-1]), lambda a, s: F.when(a.isNull() | (s.risk > a.risk), s).otherwise(a))
    rows = rows.where(F.size("s") > 0).select("root", "path", once(best).alias("b")).where(F.col("b.risk") >= risk_rank(min_risk))
    return rows.select("root", "path", risk_name(F.col("b.risk")).alias("risk"), "b.rule", "b.label")


def repeated_counts(found: DataFrame) -> DataFrame:
    """Secrets that are the best hit of two files or more: root, value_hash, masked (of the first path), risk, count. Plain
    aggregates: a secret in millions of files is one row."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk")).cast("int") - 1
    rows = found.where("value_hash is not null")
    g = rows.groupBy("root", "value_hash").agg(F.max(rank).alias("r"), F.min_by("masked", P.parts("path")).alias("masked"), F.count("*").alias("count"))
    return g.where("count >= 2").select("root", "value_hash", "masked", risk_name(F.col("r")).alias("risk"), "count")


def repeated_paths(found: DataFrame) -> DataFrame:
    """root, value_hash, path: the files of the repeated secrets, a row each."""
    rows = found.where("value_hash is not null").select("root", "value_hash", "path")
    return rows.join(repeated_counts(found).select("root", "value_hash"), ["root", "value_hash"], "left_semi")


def repeated_secrets(found: DataFrame) -> DataFrame:
    """repeated_counts with all paths in one array, in path order: for a report of few files; repeated_paths has them as
    rows."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk")).cast("int") - 1
    rows = found.where("value_hash is not null").withColumn("o", F.struct(P.parts("path").alias("parts"), "path", "masked"))
    g = rows.groupBy("root", "value_hash").agg(F.max(rank).alias("r"), F.array_sort(F.collect_list("o")).alias("o")).where(F.size("o") >= 2)
    return g.select("root", "value_hash", F.element_at("o", 1)["masked"].alias("masked"), risk_name(F.col("r")).alias("risk"), F.transform("o", lambda x: x.path).alias("paths"), F.size("o").cast("long").alias("count"))


def risk_gate_code(policy: str) -> Column:
    """The aggregate of findings that a policy (ignore, critical, high) asks for: 2 if one reaches it, else 0."""
    at = {"ignore": [], "critical": ["Critical"], "high": ["High", "Critical"]}[policy]
    hit = F.coalesce(F.bool_or(F.col("risk").isin(at)) if at else F.lit(None).cast("boolean"), F.lit(False))
    return F.when(hit, 2).otherwise(0)


def risk_gate(found: DataFrame, policy: str = "critical") -> DataFrame:
    """exit_code: 2 if a finding reaches the policy (ignore, critical, high), else 0."""
    return found.agg(risk_gate_code(policy).alias("exit_code"))


def risk_gates(found: DataFrame, policies: tuple[str, ...] = ("ignore", "critical", "high")) -> DataFrame:
    """exit_code, policy: risk_gate of several policies, from one look at the findings."""
    each = [risk_gate_code(p) for p in policies]
    codes = found.agg(F.array(*[F.struct(c.alias("exit_code"), F.lit(p).alias("policy")) for c, p in zip(each, policies, strict=True)]).alias("codes"))
    return codes.select(F.inline("codes"))


def with_git_status(found: DataFrame, status: DataFrame, repo: bool = True, nearest: DataFrame | None = None) -> DataFrame:
    """findings with git_status: as listed, else tracked; null if there is no repository (repo false). With nearest (root,
    path, repo), files that lie in no repository are unknown."""
    s = status.select("root", "path", "status").dropDuplicates(["root", "path"])
    out = found.join(s, ["root", "path"], "left")
    value = F.coalesce("status", F.lit("tracked")) if repo else F.lit(None).cast("string")
    if repo and nearest is not None:
        out = out.join(nearest.select("root", "path", F.col("repo").isNotNull().alias("_held")), ["root", "path"], "left")
        value = F.when(F.coalesce("_held", F.lit(False)), value).otherwise("unknown")
    return out.withColumn("git_status", value).select(*found.columns, "git_status")


def scan_job(contents: DataFrame, entries: DataFrame, status: DataFrame | None = None, gate: str = "critical", **options) -> dict[str, DataFrame]:
    """The whole scan: findings with git status and order, repeats, and per root a summary (files_scanned, findings,
    repeated, exit_code)."""
    walk = {k: v for k, v in options.items() if k in ("max_depth", "policy")}
    # four steps look at the findings; the texts are read once for them all
    found = written(findings(contents, **options), "findings")
    repeats = repeated_counts(found)
    from treeledger.operators import repositories  # which itself needs git_status_of

    near = repositories.nearest_repository(found.select("root", "path"), entries)
    flagged = with_git_status(found, status, nearest=near) if status is not None else found.withColumn("git_status", F.lit(None).cast("string"))
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk")).cast("int") - 1
    least = {"ignore": 99, "critical": risk_rank("Critical"), "high": risk_rank("High")}[gate]
    summary = scanned_files(contents, **walk).groupBy("root").agg(F.count("*").alias("files_scanned"))
    summary = summary.join(found.groupBy("root").agg(F.count("*").alias("findings"), F.max(rank).alias("most")), "root", "left")
    summary = summary.join(repeats.groupBy("root").agg(F.count("*").alias("repeated")), "root", "left")
    summary = summary.select(
        "root", "files_scanned", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("repeated", F.lit(0)).alias("repeated"),
        F.when(F.col("most") >= least, 2).otherwise(0).alias("exit_code"),
    )
    return {"findings": in_order(flagged), "repeated": repeats, "summary": summary}


def git_status_of(xy: Column) -> Column:
    """Porcelain XY to a status."""
    return (
        F.when(xy == "??", "untracked").when(xy == "!!", "ignored").when(xy.contains("M"), "modified")
        .when(F.substring(xy, 1, 1).isin("A", "R", "C"), "staged").when(xy.contains("D"), "deleted")
        .when(F.trim(xy) == "", "tracked").otherwise("unknown")
    )
