"""A listing of directory trees as a data source: one row an entry, links named but never followed.

What is asked of depth, pruned or root reaches the walk itself: directories that it excludes are not opened. The walk is dealt
among tasks by hash of name inside a directory. ``directory_sizes`` measures directories level by level, each level dealt
anew; with its figures a listing gives every large directory as many tasks as it needs.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, Not

from treeledger.functions import paths as P
from treeledger.functions.rules import SKIP_EXACT, SKIP_SUFFIX
from treeledger.sources.store import written

SCHEMA = "root string, path string, kind string, size_bytes long, error string, depth int, pruned boolean"
#: Tasks that share a root whose directories were not measured.
UNMEASURED = 32
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Share(InputPartition):
    """Of a directory's entries those whose name falls to this share, with all below them but what has shares itself."""

    root: str
    top: str
    share: int
    shares: int
    others: tuple[str, ...]


def _text(name: str) -> str:
    return os.fsencode(name).decode("utf-8", "replace")


def prunes(policy: P.Policy, name: str) -> bool:
    """paths.skipped_dir for a name in Python."""
    if policy.default and (name in SKIP_EXACT or name.endswith(SKIP_SUFFIX)):
        return True
    if any(name.endswith(c[1:]) if c.startswith("*") else name == c for c in policy.custom):
        return True
    return policy.hidden and name.startswith(".") and len(name) > 1


class TreeReader(DataSourceReader):
    """What can't be read is a row of kind error, with the reason."""

    def __init__(self, roots: list[str], policy: P.Policy, measured: list):
        self.roots, self.policy, self.measured = roots, policy, measured
        self.max_depth, self.prune, self.nothing = None, False, False

    def _at_most(self, depth: int) -> None:
        self.max_depth = depth if self.max_depth is None else min(depth, self.max_depth)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case LessThanOrEqual(("depth",), n):
                    self._at_most(n)
                case LessThan(("depth",), n):
                    self._at_most(n - 1)
                case EqualTo(("pruned",), False) | Not(EqualTo(("pruned",), True)):
                    self.prune = True
                case EqualTo(("root",), r):
                    self.roots = [x for x in self.roots if _text(x) == r]
                case In(("root",), rs):
                    self.roots = [x for x in self.roots if _text(x) in rs]
                case _:
                    yield f

    def partitions(self):
        found = []
        heavy: dict[str, dict[str, int]] = {}
        for root, top, shares in self.measured:
            heavy.setdefault(root, {})[top] = shares
        for root in self.roots:
            mine = heavy.get(root, {})
            for top, shares in {"": UNMEASURED if not mine else 1, **mine}.items():
                others = tuple(t for t in mine if t != top and (os.path.dirname(t) == top))
                found += [Share(root, top, i, shares, others) for i in range(shares)]
        return found or [Share("", "", 0, 0, ())]

    def _entry(self, root: str, path: str, entry: os.DirEntry, depth: int, pruned: bool) -> tuple:
        row = lambda kind, size=0, error=None, cut=pruned: (_text(root), _text(path), kind, size, error, depth, cut)
        try:
            if entry.is_symlink():
                return row("symlink")
            if entry.is_dir(follow_symlinks=False):
                return row("dir", cut=pruned or prunes(self.policy, entry.name))
            if entry.is_file(follow_symlinks=False):
                return row("file", entry.stat(follow_symlinks=False).st_size)
            return row("other")
        except OSError as x:
            return row("error", error=type(x).__name__)

    def read(self, partition: Share) -> Iterator[tuple]:
        if partition.shares == 0:
            return
        above = partition.top.split("/") if partition.top else []
        cut = any(prunes(self.policy, c) for c in above)
        if self.prune and cut or self.max_depth is not None and len(above) >= max(1, self.max_depth) and above:
            return
        stack = [(partition.top, len(above) + 1, cut)]
        others, first = set(partition.others), True
        while stack:
            at, depth, pruned = stack.pop()
            try:
                with os.scandir(os.path.join(partition.root, at)) as it:
                    entries = list(it)
            except OSError as e:
                if not first or partition.share == 0:
                    yield (_text(partition.root), _text(at), "error", 0, type(e).__name__, depth - 1, pruned)
                continue
            for e in entries:
                if first and zlib.crc32(os.fsencode(e.name)) % partition.shares != partition.share:
                    continue
                path = os.path.join(at, e.name)
                row = self._entry(partition.root, path, e, depth, pruned)
                if not (self.prune and row[6]) and not (self.max_depth is not None and depth > self.max_depth):
                    yield row
                deeper = self.max_depth is None or depth < self.max_depth
                if row[2] == "dir" and deeper and not (self.prune and row[6]) and not (first and path in others):
                    stack.append((path, depth + 1, row[6]))
            first = False


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treelisting"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        policy = json.loads(self.options.get("policy", "{}"))
        policy = P.Policy(policy.get("default", True), tuple(policy.get("custom", ())), policy.get("hidden", False))
        return TreeReader(json.loads(self.options["roots"]), policy, json.loads(self.options.get("measured", "[]")))


def _level(frontier: DataFrame, policy: P.Policy, prune: bool) -> DataFrame:
    """root, dir, entries, below (names of its directories) of every directory of frontier (root, dir)."""
    schema = "root string, dir string, entries long, below array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for root, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with os.scandir(os.path.join(root, at)) as it:
                        n, below = 0, []
                        for e in it:
                            n += 1
                            if e.is_dir(follow_symlinks=False) and not (prune and prunes(policy, e.name)):
                                below.append(e.name)
                        rows.append((root, at, n, below))
                except OSError:
                    rows.append((root, at, 0, []))
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["root", "dir", "entries", "below"])

    return frontier.mapInArrow(run, schema)


def directory_sizes(spark: SparkSession, roots: list[str], policy: P.Policy = P.DEFAULT, prune: bool = True, max_depth: int = 64) -> DataFrame:
    """root, dir, entries of the directories of the roots: entries in the directory and in all below it. Directories are
    visited level by level, each level dealt out evenly, so that a lopsided tree keeps no task busy alone."""
    tasks = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(r, "") for r in roots], "root string, dir string")
    levels = None
    for _ in range(P.check_depth(max_depth)):
        level = written(_level(frontier.repartition(tasks), policy, prune), "level")
        levels = level if levels is None else levels.unionByName(level)
        child = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
        frontier = level.select("root", "dir", F.explode("below").alias("name")).select("root", child.alias("dir"))
        if frontier.isEmpty():
            break
    up = F.concat(P.ancestors(P.parts("dir")), F.array("dir"))
    each = levels.select("root", F.explode(up).alias("dir"), "entries")
    return each.groupBy("root", "dir").agg(F.sum("entries").alias("entries"))


def heavy_directories(sizes: DataFrame, tasks: int) -> list[tuple[str, str, int]]:
    """root, directory, shares of the directories that hold more than a task's part of all entries. On one level there are
    at most as many as tasks, so that the list is bounded by tasks times depth, whatever the tree."""
    total = sizes.where("dir = ''").agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    part = max(1, total // max(1, tasks))
    # its own part: what is left of it without the large directories in it
    large = sizes.where((F.col("entries") > part) | (F.col("dir") == ""))
    found = {(r.root, r.dir): r.entries for r in large.collect()}
    out = []
    for (root, top), n in sorted(found.items()):
        inner = sum(m for (r, d), m in found.items() if r == root and d and d != top and os.path.dirname(d) == top)
        out.append((root, top, max(1, math.ceil(2 * (n - inner) / part))))
    return out


def list_trees(spark: SparkSession, roots: list[str], policy: P.Policy = P.DEFAULT, measured: list | None = None, where: Column | str | None = None) -> DataFrame:
    """root, path, kind (file, dir, symlink, other, error), size_bytes, error, depth, pruned (in, or as a directory itself,
    a skipped directory of policy) of everything below the roots that where fits. Every executor must see the roots at the
    same path. Names that start with a dot are listed like any other. What where says of depth, pruned and root keeps the
    walk out of what it excludes. measured: heavy_directories, for trees that are lopsided.

    Spark keeps a reader, with what was pushed into it, for all queries on one loaded source. So where goes into a source of
    its own, and the counter above it keeps filters of later queries from reaching that."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(TreeSource)
    own = json.dumps({"default": policy.default, "custom": list(policy.custom), "hidden": policy.hidden})
    out = spark.read.format("treelisting").option("roots", json.dumps(list(roots))).option("policy", own)
    out = out.option("measured", json.dumps(measured or [])).load()
    out = out if where is None else out.where(where)
    return out.observe(f"listed-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("entries"))
