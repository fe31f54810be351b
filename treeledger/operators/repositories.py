"""Repositories: raw status records, and the repository that a file belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.operators.secrets import git_status_of


def parse_status(raw: DataFrame) -> DataFrame:
    """root, repo, path, status from rows (root, repo, raw) of NUL-separated porcelain v1 records.

    A record with R or C in its code takes up the field after it, whatever that looks like. Whether a field is taken up
    thus hangs on the run of such fields just before it: every second one of a run is. Empty fields don't count, fields
    under four bytes are ignored, and of several records of a path the last holds."""
    key = ["root", "repo"]
    fields = F.filter(F.split("raw", "\0"), lambda x: x != "")
    rows = raw.select(*key, F.posexplode(fields).alias("pos", "field"))
    takes = (F.octet_length("field") >= 4) & F.substring("field", 1, 2).rlike("[RC]")
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("takes", takes)
    rows = rows.withColumn("stop", F.coalesce(F.max(F.when(~F.col("takes"), F.col("pos"))).over(before), F.lit(-1)))
    rows = rows.where(((F.col("pos") - 1 - F.col("stop")) % 2 == 0) & (F.octet_length("field") >= 4))
    status = git_status_of(F.substring("field", 1, 2))
    rows = rows.select(*key, F.expr("substring(field, 4)").alias("path"), "pos", status.alias("status"))
    return rows.groupBy(*key, "path").agg(F.max_by("status", "pos").alias("status"))


def repositories(entries: DataFrame) -> DataFrame:
    """root, repo: directories that hold a .git directory or pointer file."""
    held = entries.where((F.element_at(F.concat(F.array(F.lit("")), "parts"), -1) == ".git") & F.col("kind").isin("dir", "file"))
    return held.select("root", P.join_parts(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("repo")).distinct()


def nearest_repository(files: DataFrame, entries: DataFrame, scope: str = "file") -> DataFrame:
    """root, path, repo: the deepest repository above each file (scope file), or the root's own one for all its files
    (scope root); null without one. Files meet repositories by an equi join on their ancestors."""
    repos = repositories(entries)
    if scope == "root":
        return files.select("root", "path").join(repos.where("repo = ''"), "root", "left")
    up = files.select("root", "path", F.posexplode(P.ancestors(P.parts("path"))).alias("depth", "repo"))
    best = up.join(repos, ["root", "repo"], "left_semi").groupBy("root", "path").agg(F.max_by("repo", "depth").alias("repo"))
    return files.select("root", "path").join(best, ["root", "path"], "left")
