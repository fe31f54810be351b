"""Project discovery: candidates by marker, language, frameworks, size and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.rules import markers

MAX_DEPTH = 6


def _walked(entries: DataFrame, max_depth: int, policy: P.Policy) -> DataFrame:
    """Entries whose directory the walk inspects: it is reached (not pruned) and at most max_depth deep."""
    above = F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0)))
    reached = (F.size("parts") >= 1) & (F.size("parts") - 1 <= P.check_depth(max_depth)) & ~P.skipped(above, F.lit("dir"), policy)
    return entries.where(reached).withColumn("parent", P.join_parts(above)).withColumn("name", F.element_at("parts", -1))


def candidates(entries: DataFrame, extra=(), accept_git_only: bool = True, max_depth: int = MAX_DEPTH, policy: P.Policy = P.DEFAULT) -> DataFrame:
    """root, path, name, hits (marker structs in table order), is_git_repo."""
    dim = F.broadcast(markers(entries.sparkSession, extra))
    hits = _walked(entries, max_depth, policy).join(dim, ["name", "kind"])
    g = hits.groupBy("root", F.col("parent").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "name", "kind", "hint", "level"))).alias("hits"),
        F.bool_or(F.col("name") == ".git").alias("is_git_repo"),
        F.count_if(~((F.col("name") == ".git") & (F.col("kind") == "dir"))).alias("others"),
    )
    g = g if accept_git_only else g.where("others > 0")
    last = F.element_at(F.concat(F.array("root"), P.parts("path")), -1)
    return g.select("root", "path", last.alias("name"), "hits", "is_git_repo")


def language() -> Column:
    """Hint of the best level, ties to the first hit; a null hint that wins stays null."""
    best = F.array_sort(F.transform("hits", lambda h: F.struct(h.level.alias("level"), h.ord.alias("ord"), h.hint.alias("hint"))))
    return F.element_at(best, 1)["hint"]


def marker_names() -> Column:
    return F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"])))


_JVM = ("pom.xml", "build.gradle", "build.gradle.kts")
_PYTHON = ("pyproject.toml", "setup.py", "requirements.txt")
#: framework, markers that gate it, names that show it (a trailing * means one character or more)
FRAMEWORKS = [
    ("Next.js", ("package.json",), ("next.config.js", "next.config.mjs", "next.config.ts")),
    ("Nuxt", ("package.json",), ("nuxt.config.*",)),
    ("Angular", ("package.json",), ("angular.json",)),
    ("Vite", ("package.json",), ("vite.config.*",)),
    ("Deno", ("package.json",), ("deno.json",)),
    ("Django", _PYTHON, ("manage.py",)),
    ("sbt", _JVM, ("build.sbt",)),
    ("Rails", ("Gemfile",), ("config/application.rb",)),
]


def _shows(listing: Column, shown: str) -> Column:
    if shown.endswith("*"):
        return F.exists(listing, lambda n: F.startswith(n, F.lit(shown[:-1])) & (F.length(n) > len(shown) - 1))
    return F.array_contains(listing, shown)


def _wanted(name: Column, rules) -> Column:
    """Whether a file's name is one that a rule shows a framework by."""
    out = F.lit(False)
    for shown in {s for _, _, names in rules for s in names if "/" not in s}:
        out = out | (F.startswith(name, F.lit(shown[:-1])) if shown.endswith("*") else name == shown)
    return out


def with_stack(found: DataFrame, entries: DataFrame | None, rules=FRAMEWORKS) -> DataFrame:
    """candidates with language, markers, frameworks. Only entries that a rule names are joined; without a listing no rule
    shows. rules (framework, markers that gate it, names that show it; dir/name for a file one level down) may be the
    user's own. A candidate without hits is not gated: every rule looks at its listing."""
    parent = P.join_parts(F.slice("parts", F.lit(1), F.size("parts") - 1))
    name = F.element_at("parts", -1)
    none = F.array().cast("array<string>")
    if entries is None:
        rows = found.withColumn("listing", none)
    else:
        # a file that a rule names as dir/name is listed for the directory above dir
        below = F.concat_ws("/", F.element_at("parts", -2), name)
        deep = [s for _, _, names in rules for s in names if "/" in s]
        files = entries.where("kind = 'file' and size(parts) > 0")
        near = files.where(_wanted(name, rules)).select("root", parent.alias("path"), name.alias("n"))
        if deep:
            up = P.join_parts(F.slice("parts", F.lit(1), F.size("parts") - 2))
            near = near.unionByName(files.where("size(parts) >= 2").where(below.isin(deep)).select("root", up.alias("path"), below.alias("n")))
        listing = near.groupBy("root", "path").agg(F.collect_set("n").alias("listing"))
        rows = found.join(listing, ["root", "path"], "left").withColumn("listing", F.coalesce("listing", none))
    names = F.transform("hits", lambda h: h["name"])
    each = []
    for label, gates, shown in rules:
        gate = F.arrays_overlap(names, F.array(*map(F.lit, gates))) | (F.size(names) == 0)
        seen = _shows(F.col("listing"), shown[0])
        for s in shown[1:]:
            seen = seen | _shows(F.col("listing"), s)
        each.append(F.when(gate & seen, F.lit(label)))
    frameworks = F.array_distinct(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return rows.select("root", "path", "name", language().alias("language"), frameworks.alias("frameworks"), marker_names().alias("markers"), "is_git_repo")


def project_sizes(found: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH, policy: P.Policy = P.DEFAULT) -> DataFrame:
    """root, path, size_bytes: regular files below each project, skip policy and depth counted from the project. Files are
    summed up by directory first; each directory's sum goes to the directories above it that see it (no deeper than the
    depth, below the last pruned name), so that what is shuffled grows with directories, not files, and a root's own sum is
    put together from those of its tasks."""
    files = entries.where("kind = 'file' and size(parts) > 0")
    above = F.slice("parts", F.lit(1), F.size("parts") - 1)
    sums = files.groupBy("root", P.join_parts(above).alias("dir")).agg(F.sum("size_bytes").alias("size_bytes"))
    sums = sums.withColumn("d", P.parts("dir"))
    least = F.greatest(F.size("d") + 1 - P.check_depth(max_depth), P.last_where(F.col("d"), lambda c: P.skips(c, policy)))
    seen = F.when(least <= F.size("d"), F.transform(F.sequence(F.greatest(least, F.lit(0)), F.size("d")), lambda k: P.join_parts(F.slice("d", F.lit(1), k))))
    up = sums.select("root", F.explode(seen).alias("path"), "size_bytes").groupBy("root", "path").agg(F.sum("size_bytes").alias("size_bytes"))
    out = found.select("root", "path").join(up, ["root", "path"], "left")
    return out.select("root", "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))


def projects(entries: DataFrame, rules=FRAMEWORKS, **options) -> DataFrame:
    found = candidates(entries, **options)
    walk = {k: v for k, v in options.items() if k in ("max_depth", "policy")}
    return with_stack(found, entries, rules).join(project_sizes(found, entries, **walk), ["root", "path"])


def scan_report(found: DataFrame) -> DataFrame:
    return found.groupBy("root").agg(F.count("*").alias("projects"), F.sum("size_bytes").alias("total_size_bytes"), F.lit(1).alias("schema_version"))


def stack_label() -> Column:
    return F.when(F.col("language").isNull(), F.lit("-")).otherwise(F.array_join(F.concat(F.array("language"), "frameworks"), " + "))
