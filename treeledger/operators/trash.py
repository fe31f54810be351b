"""Build trash: outermost directories that a strategy names, their sizes and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.functions.rules import trash_patterns

DEFAULT_STRATEGIES = ("rust", "node", "python")
MAX_DEPTH = 6


def _matches(name: Column, patterns: list[tuple[str, str]]) -> Column:
    fits = F.lit(False)
    for _, p in patterns:
        fits = fits | P.glob_match(name, F.lit(p))
    return fits


def _first_match(name: Column, patterns: list[tuple[str, str]]) -> Column:
    """strategy and pattern of the first that fits, else null."""
    struct = lambda s, p: F.struct(F.lit(s).alias("strategy"), F.lit(p).alias("pattern"))
    return F.coalesce(*[F.when(P.glob_match(name, F.lit(p)), struct(s, p)) for s, p in patterns])


def trash_dirs(entries: DataFrame, strategies=DEFAULT_STRATEGIES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """root, project, path, strategy, pattern_name, size_bytes. A project is a first-level directory; depth counts from
    it. The skip policy does not apply. Inside a match nothing else is one: whether a directory is the outermost, and in
    which one a file lies, its own path tells, so that only sums of sizes are shuffled. entries hold every directory above
    an entry, as any listing does."""
    patterns = trash_patterns(strategies)
    p = F.col("parts")
    # of the directories above (a file) or up to (a directory) an entry, the first below the project that matches
    first = F.array_position(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda c: _matches(c, patterns)), True)
    dirs = entries.where((F.col("kind") == "dir") & (F.size(p) >= 2) & (F.size(p) - 1 <= max_depth)).where(first == F.size(p) - 1)
    hit = dirs.select("root", "path", "parts", _first_match(F.try_element_at("parts", F.lit(-1)), patterns).alias("m"))
    inside = F.array_position(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0))), lambda c: _matches(c, patterns)), True)
    files = entries.where("kind = 'file' and size(parts) > 2").select("root", "parts", "size_bytes", inside.alias("at")).where((F.col("at") > 0) & (F.col("at") <= max_depth))
    top = P.join_parts(F.slice("parts", F.lit(1), F.col("at").cast("int") + 1))
    sizes = files.groupBy("root", top.alias("path")).agg(F.sum("size_bytes").alias("s"))
    out = hit.join(sizes, ["root", "path"], "left")
    return out.select("root", F.element_at("parts", 1).alias("project"), "path", "m.strategy", F.col("m.pattern").alias("pattern_name"), F.coalesce("s", F.lit(0)).alias("size_bytes"))


def by_strategy(trash: DataFrame) -> DataFrame:
    return trash.groupBy("root", "strategy").agg(F.count("*").alias("dirs"), F.sum("size_bytes").alias("bytes"))


def rollup(trash: DataFrame) -> DataFrame:
    """root, project, strategy, level, dirs, bytes: totals of every strategy of a project (level 0), of a project (1) and of
    a root (3). level tells subtotals from rows whose own project or strategy is null."""
    rows = trash.select("root", "project", "strategy", "size_bytes")
    # a root is in every grouping set: totals of different roots are never added up
    cube = rows.groupingSets(
        [[F.col("root"), F.col("project"), F.col("strategy")], [F.col("root"), F.col("project")], [F.col("root")]],
        "root", "project", "strategy",
    )
    return cube.agg(F.grouping_id("root", "project", "strategy").cast("int").alias("level"), F.count("*").alias("dirs"), F.sum("size_bytes").alias("bytes")).select("root", "project", "strategy", "level", "dirs", "bytes")
