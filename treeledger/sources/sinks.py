"""What runs leave behind in a store folder: reports, packs, encrypted stashes, manifests, reusable results."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.functions import paths as P

STORE_VERSION = "1.0"
SCHEMA_VERSION = 1
MANIFEST = (
    "schema_version int, created_at string, success boolean, "
    "stages array<struct<ord: int, stage: string, files: long, bytes: long, message: string>>, artifacts map<string, string>, "
    "yyyy string, mm string, run string"
)


def check_roots(entries: DataFrame, requested: DataFrame) -> DataFrame:
    """root, problem (missing, not_a_directory) of the requested roots that can't be scanned. A root is there if any entry
    is; it is no directory if its own entry says so."""
    own = entries.groupBy("root").agg(F.bool_or((F.col("path") == "") & (F.col("kind") != "dir")).alias("other"))
    rows = requested.select("root").distinct().join(own, "root", "left")
    problem = F.when(F.col("other").isNull(), "missing").when(F.col("other"), "not_a_directory")
    return rows.select("root", problem.alias("problem")).where("problem is not null")


def check_version(spark: SparkSession, store: str, version: str = STORE_VERSION) -> None:
    """Write the store's version where it has none; refuse a store of another major version."""
    path = f"{store}/version"
    try:
        held = [x.version for x in spark.read.schema("version string").json(path).limit(2).collect()]
    except AnalysisException:
        spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.json(path)
        return
    if len(held) != 1 or str(held[0]).strip().split(".")[0] != version.split(".")[0]:
        raise ValueError(f"the store's version is {held}, this code writes {version}")


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Findings or projects in their column order, as JSON lines or Parquet."""
    df.write.mode(mode).format(fmt).save(path)


def free_names(planned: DataFrame, existing: DataFrame, short_id: str) -> DataFrame:
    """planned (name, ...) with final: the name, or name__short_id where it is taken already. A name taken even then, or
    planned twice, is an error."""
    held = existing.select("name").distinct()
    rows = planned.join(held.withColumn("taken", F.lit(True)), "name", "left")
    rows = rows.withColumn("final", F.when(F.col("taken"), F.concat_ws("__", "name", F.lit(short_id))).otherwise(F.col("name"))).drop("taken")
    again = held.select(F.col("name").alias("final"), F.lit(True).alias("again"))
    n = rows.groupBy("final").agg(F.count("*").alias("n"))
    rows = rows.join(again, "final", "left").join(n, "final")
    clash = F.col("again").isNotNull() | (F.col("n") > 1)
    final = F.when(clash, F.raise_error(F.concat(F.lit("name collision: "), F.col("final")))).otherwise(F.col("final"))
    return rows.select(*planned.columns, final.alias("final"))


def _dated(df: DataFrame, slug: Column, ts: str) -> DataFrame:
    return df.select("*", slug.alias("slug"), F.lit(ts[:4]).alias("yyyy"), F.lit(ts[4:6]).alias("mm"))


def write_packs(routed: DataFrame, contents: DataFrame, store: str, ts: str) -> None:
    """The files that are routed to pack, with their contents, below packs/yyyy/mm/slug__ts, in component order. The ranges
    are over project and path, so that a large project spreads over many tasks. Projects of one slug are told apart by a
    short id of root and project. A run that is repeated replaces its own folders and no others."""
    allowed = routed.where("route = 'pack'").select("root", "project", "path")
    rows = allowed.join(contents.select("root", "path", "text"), ["root", "path"]).withColumn("parts", P.parts("path"))
    slug = P.slug(F.col("project"))
    same = allowed.select("root", "project", slug.alias("s")).distinct().groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.withColumn("s", slug).join(same, "s", "left")
    unique = F.when(F.col("n") > 1, F.concat_ws("__", "s", P.short_id(F.concat_ws("/", "root", "project")))).otherwise(F.col("s"))
    rows = _dated(rows, F.concat_ws("__", unique, F.lit(ts)), ts).drop("s", "n")
    rows = rows.repartitionByRange("root", "project", "parts").sortWithinPartitions("slug", "root", "project", "parts")
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    out.partitionBy("yyyy", "mm", "slug").parquet(f"{store}/packs")


def read_packs(spark: SparkSession, store: str) -> DataFrame:
    """slug, position, root, project, path, text of the packed files, position from 1 in the order of their archive: that of
    its Parquet files, and in a file that of its rows. Only files are put in sequence, not rows; the texts aren't moved."""
    rows = spark.read.parquet(f"{store}/packs").select("slug", "root", "project", "path", "text", "_metadata.file_path", "_metadata.row_index")
    files = spark.read.parquet(f"{store}/packs").select("slug", "_metadata.file_path").groupBy("slug", "file_path").agg(F.count("*").alias("n"))
    before = Window.partitionBy("slug").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(files, "file_path")
    return rows.select("slug", (F.col("before") + F.col("row_index") + 1).alias("position"), "root", "project", "path", "text")


def _one_key(rows: DataFrame, key: DataFrame) -> DataFrame:
    """rows with the one key of a table that is checked to hold one."""
    if key.where(F.octet_length("key").isin(16, 24, 32)).count() != 1 or key.count() != 1:
        raise ValueError("the key table must hold one key of 16, 24 or 32 bytes")
    return rows.join(F.broadcast(key.select(F.col("key").alias("_key"))), how="cross")  # one row, counted above


def _sealed_for() -> Column:
    """What a sealed text is bound to: its root and path, each with its length, so that no two pairs give the same."""
    named = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c))
    return F.concat(named("root"), named("path")).cast("binary")


def write_stash(plan: DataFrame, contents: DataFrame, key: DataFrame, store: str, slug: str, ts: str) -> DataFrame:
    """The planned files, encrypted, below secrets/yyyy/mm/slug; returns root, path, size_bytes of what was written. AES-GCM
    with root and path as associated data: a sealed text opens only beside its own path. key: one row, column key (16, 24
    or 32 bytes), so that it stays out of the plan's text."""
    if plan.isEmpty():
        raise ValueError("nothing to stash")
    rows = plan.select("root", "path").join(contents.select("root", "path", "text"), ["root", "path"])
    sealed = F.aes_encrypt(F.col("text").cast("binary"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _sealed_for())
    rows = _one_key(rows, key).select("root", "path", F.octet_length("text").cast("long").alias("size_bytes"), sealed.alias("sealed"))
    out = f"{store}/secrets/yyyy={ts[:4]}/mm={ts[4:6]}/slug={slug}__{ts}"
    rows.write.option("compression", "none").parquet(out)
    return plan.sparkSession.read.parquet(out).select("root", "path", "size_bytes")


def open_stash(sealed: DataFrame, key: DataFrame, strict: bool = True) -> DataFrame:
    """root, path, text of sealed rows (root, path, sealed). A row that was changed, moved to another path or sealed with
    another key is an error, or without strict a null text."""
    args = (F.col("sealed"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), _sealed_for())
    text = (F.aes_decrypt if strict else F.try_aes_decrypt)(*args)
    return _one_key(sealed.select("root", "path", "sealed"), key).select("root", "path", text.cast("string").alias("text"))


def read_stash(spark: SparkSession, store: str) -> DataFrame:
    """The sealed rows of all stashes of a store."""
    return spark.read.parquet(f"{store}/secrets")


def write_manifest(stages: DataFrame, artifacts: dict[str, str | None], stash: DataFrame, store: str, ts: str, run: str | None = None) -> None:
    """One JSON row a run below manifests/yyyy/mm/run: stages and artifacts (paths relative to the store, no absolute ones);
    the stashed files are rows of a table beside it, as their number grows with the input. run (the stamp, if not given)
    names the run: done again, it replaces its own rows and no others. The manifest comes last: a run that fails before has
    none, and read_manifests doesn't see its files."""
    bad = [a for a in artifacts.values() if a and (a.startswith("/") or ".." in a.split("/"))]
    if bad:
        raise ValueError(f"artifact paths must be relative to the store: {bad}")
    if not any(artifacts.values()):
        return
    run = run or ts
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError(f"a run can't be named {run!r}")
    names = sorted(artifacts)
    ok = F.col("ok") if "ok" in stages.columns else F.lit(True)
    one = stages.groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", "stage", "files", "bytes", "message"))).alias("stages"), F.bool_and(ok).alias("success"))
    one = one.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(ts).alias("created_at"), "success", "stages",
        F.struct(*[F.lit(artifacts[n]).cast("string").alias(n) for n in names]).alias("artifacts"),
    )

    folder = lambda table: f"{store}/{table}/yyyy={ts[:4]}/mm={ts[4:6]}/run={run}"
    spark = stages.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(folder("manifests"))
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)  # from here on the run isn't done
    stash.select("root", "path", "size_bytes", F.lit(ts).alias("created_at")).write.mode("overwrite").json(folder("manifest_files"))
    one.coalesce(1).write.mode("overwrite").json(folder("manifests"))


def read_manifests(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """The manifests of the runs that came to their end, and the stashed files of these runs."""
    runs = spark.read.schema(MANIFEST).json(f"{store}/manifests")
    files = spark.read.schema("root string, path string, size_bytes long, created_at string, yyyy string, mm string, run string").json(f"{store}/manifest_files")
    return runs, files.join(runs.select("yyyy", "mm", "run"), ["yyyy", "mm", "run"], "left_semi")


def result_key(root: Column, max_depth: Column, policy: Column) -> Column:
    """The same for the same root, depth and policy; no secret."""
    return F.sha2(F.concat_ws("\0", root, max_depth.cast("string"), policy), 256)


def reuse(spark: SparkSession, store: str, root: str, max_depth: int, policy: str, tool: str, build: Callable[[], DataFrame], refresh: bool = False) -> tuple[DataFrame, bool]:
    """A result and whether it was held already. It is served if schema, tool, root, depth and policy all match; a
    missing or broken snapshot is built anew, and failing to store it does no harm."""
    key = spark.range(1).select(result_key(F.lit(root), F.lit(max_depth), F.lit(policy))).first()[0]
    path = f"{store}/snapshots/cache_key={key}"
    stamp = {"_schema": SCHEMA_VERSION, "_tool": tool, "_root": root, "_depth": max_depth, "_policy": policy}
    if not refresh:
        try:
            held = spark.read.parquet(path)
            fits = F.lit(True)
            for c, v in stamp.items():
                fits = fits & F.col(c).eqNullSafe(F.lit(v))
            counted = held.agg(F.count_if(fits).alias("fit"), F.count("*").alias("all")).first()
            if counted.fit == counted["all"] and counted.fit > 0:
                return held.drop(*stamp), True
        except Exception:  # noqa: BLE001 - whatever is wrong with a snapshot, it counts as a miss
            pass
    built = build()
    try:
        built.select("*", *[F.lit(v).alias(c) for c, v in stamp.items()]).write.mode("overwrite").parquet(path)
    except Exception:  # noqa: BLE001 - the result is served all the same
        return built, False
    return spark.read.parquet(path).drop(*stamp), False
