"""Project discovery over many roots that uses earlier results again: only roots without a fitting one are looked at.

A store of results holds generations (rows of projects, written once and never changed) and an index: the key of every
root's result with the generation that holds it. A run joins its requests with the index, works out the misses from their
entries alone, writes these as a new generation and then a new index, and at last turns the pointer to that index. Whatever
stops a run before, the pointer still names an index whose generations are whole.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.operators import projects
from treeledger.sources.sinks import SCHEMA_VERSION, result_key
from treeledger.sources.store import read_pointer, turn_pointer, written

INDEX = "cache_key string, schema_version int, tool string, root string, max_depth int, policy string, state string, generation string"
_FIT = ["cache_key", "schema_version", "tool", "root", "max_depth", "policy"]
PROJECT = ["root", "path", "name", "language", "frameworks", "markers", "is_git_repo", "size_bytes"]


def _index(spark: SparkSession, store: str) -> DataFrame:
    """The index that the pointer names, without generations that can't be read; no index, or a broken one, holds nothing."""
    name = read_pointer(spark, f"{store}/results/pointer")
    empty = spark.createDataFrame([], INDEX)
    if name is None:
        return empty
    try:
        found = spark.read.schema(INDEX).parquet(f"{store}/results/{name}")
        whole = []
        for g in [r.generation for r in found.select("generation").distinct().collect()]:  # a few runs, not roots
            try:
                if set(PROJECT) <= set(spark.read.parquet(f"{store}/results/{g}").columns):
                    whole.append(g)
            except AnalysisException:
                continue
        return found.where(F.col("generation").isin(whole))
    except Exception:  # noqa: BLE001 - whatever is wrong with a store, it counts as empty
        return empty


def requests(roots: DataFrame, max_depth: int = projects.MAX_DEPTH, policy: str = "default", tool: str = "1") -> DataFrame:
    """What a run asks for: of every root (column root and, if the caller can tell, state: anything that changes when the
    root does) the key of its result."""
    state = F.col("state").cast("string") if "state" in roots.columns else F.lit(None).cast("string")
    rows = roots.select("root", state.alias("state"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(tool).alias("tool"), F.lit(max_depth).alias("max_depth"), F.lit(policy).alias("policy"))
    return rows.dropDuplicates(["root"]).withColumn("cache_key", result_key(F.col("root"), F.col("max_depth"), F.col("policy")))


def discover(asked: DataFrame, entries: DataFrame, store: str, refresh: bool = False, keep: bool = True, **options) -> DataFrame:
    """The projects of the requested roots (asked: as requests gives it), with reused: whether they come from an earlier
    run. An earlier result serves if key, tool, schema, root, depth, policy and state all match; refresh serves none. Of
    entries only rows of the other roots are read: where they are stored by root (partitionBy), only those folders. options
    (rules, policy of the walk, extra) go to the projects; asked names them in its policy. Failing to store does no harm."""
    spark = asked.sparkSession
    asked = written(asked, "requests")
    index = _index(spark, store)
    fits = [asked[c] == index[c] for c in _FIT] + [asked["state"].eqNullSafe(index["state"])]
    held = asked.limit(0) if refresh else asked.join(index, fits, "left_semi")
    served = held.join(index.select("cache_key", "generation"), "cache_key")
    missed = written(asked.join(held.select("root"), "root", "left_anti"), "misses")
    depths = missed.select("max_depth").distinct().limit(2).collect()
    if len(depths) > 1:
        raise ValueError("one run asks for one depth")
    depth = depths[0][0] if depths else projects.MAX_DEPTH
    generation = f"generation-{uuid.uuid4().hex}"
    mine = entries.join(missed.select("root"), "root", "left_semi")
    built = projects.projects(written(mine, "missed-entries"), max_depth=depth, **options).select(*PROJECT)
    out = f"{store}/results/{generation}"
    try:
        built.write.parquet(out)
        built = spark.read.schema(built.schema).parquet(out)
        now = missed.select(*_FIT, "state", F.lit(generation).alias("generation"))
        name = f"index-{uuid.uuid4().hex}"
        old = index.join(missed.select("cache_key"), "cache_key", "left_anti")
        old.select(*now.columns).unionByName(now).write.parquet(f"{store}/results/{name}")
        served = written(served, "served")
        if keep:
            turn_pointer(spark, f"{store}/results/pointer", name)
    except Exception:  # noqa: BLE001 - results are given all the same
        pass
    rows = None
    for g in [r.generation for r in served.select("generation").distinct().collect()]:
        one = spark.read.schema(built.schema).parquet(f"{store}/results/{g}")
        one = one.join(served.where(F.col("generation") == g).select("root"), "root", "left_semi")
        rows = one if rows is None else rows.unionByName(one)
    fresh = built.withColumn("reused", F.lit(False))
    return fresh if rows is None else fresh.unionByName(rows.withColumn("reused", F.lit(True)))


def compact(spark: SparkSession, store: str) -> None:
    """Put what the index still names into one generation, so that the number of generations doesn't grow with the runs."""
    index = _index(spark, store)
    rows = None
    for g in [r.generation for r in index.select("generation").distinct().collect()]:
        one = spark.read.parquet(f"{store}/results/{g}").join(index.where(F.col("generation") == g).select("root"), "root", "left_semi")
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return
    generation, name = f"generation-{uuid.uuid4().hex}", f"index-{uuid.uuid4().hex}"
    rows.write.parquet(f"{store}/results/{generation}")
    index.withColumn("generation", F.lit(generation)).write.parquet(f"{store}/results/{name}")
    turn_pointer(spark, f"{store}/results/pointer", name)
