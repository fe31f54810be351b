"""Repeated secrets over contents that keep landing, with work per batch in proportion to the batch.

Three streams follow one another. The first keeps the newest version of every path, in the keyed state of a plain
aggregate, and writes those that a batch has touched, of paths that hold a secret or ever held one: other paths, by far the
most, end here. The second keeps, for each path that comes through, its secret as last told, and writes what changes: the
old secret taken back (-1), the new one counted (+1). It calls a Python function for each of these paths. The third sums
the changes by secret, also in keyed state, and writes the secrets that a batch has touched, in a folder a batch. The
table of repeats is the last row of every secret; compact() folds the folders into one base.

All are exactly once: the second by the file sink's log, the others because a batch that is tried again replaces its own
folder, and a newest version that comes twice changes nothing. A restart goes on after the last batch that was committed.
A version that arrives late, after a newer one of its path, changes nothing, so the table doesn't hang on the order or the
cut of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeledger.functions.rules import RISKS
from treeledger.operators import secrets

VERSIONS = "root string, path string, version long, text string"
NEWEST = "root string, path string, version long, value_hash string, masked string, risk_rank int"
DELTAS = "root string, value_hash string, masked string, risk_rank int, delta int"
_STATE = "version long, value_hash string, masked string, risk_rank int"
_COUNTS = "root string, value_hash string, masked string, " + ", ".join(f"n{i} long" for i in range(len(RISKS)))


def versions_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of (root, path, version, text) as they land below folder. A removed file lands with a null text. Where
    no version is given, the time at which the Parquet file was written stands for it: what lands later is newer."""
    rows = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(folder)
    return rows.withColumn("version", F.coalesce("version", F.unix_micros("_metadata.file_modification_time")))


def _place(x: tuple) -> tuple:
    return x[0], x[1] or "", -1 if x[3] is None else x[3]


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes that one path's new rows make. Of rows of one version the one with the greatest hash, then risk, holds."""
    old = state.get if state.exists else None
    new = old
    for rows in frames:
        for v, h, m, r in zip(rows["version"], rows["value_hash"], rows["masked"], rows["risk_rank"], strict=True):
            mine = (int(v), None, None, None) if h is None or pd.isna(h) else (int(v), h, m, int(r))
            if new is None or _place(mine) > _place(new):
                new = mine
    if new == old:
        return
    state.update(new)
    was, now = (old or (None,) * 4)[1:], new[1:]
    if was == now:
        return
    rows = [(key[0], *x, d) for x, d in ((was, -1), (now, 1)) if x[0] is not None]
    if rows:
        yield pd.DataFrame(rows, columns=["root", "value_hash", "masked", "risk_rank", "delta"]).astype({"risk_rank": "int32", "delta": "int32"})


def _by_batch(rows: DataFrame, folder: str, columns: str, checkpoint: str) -> DataStreamWriter:
    """What a batch of an aggregate has touched, in folder/batch_id=n."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select(*[c.split()[0] for c in columns.split(", ")]).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def newest_stream(versions: DataFrame, log: str, checkpoint: str, **options) -> DataStreamWriter:
    """The newest version of every path that a batch touches and that holds a secret or ever held one, written to
    log/batch_id=n. options go to the scan (max_depth, policy, patterns, markers). A null version counts as the oldest."""
    rows = versions.withColumn("version", F.coalesce("version", F.lit(-(1 << 62)).cast("long")))
    found = secrets.file_secrets(rows, keep=("version",), **options)
    x = F.struct("version", "value_hash", F.col("risk_rank").cast("int").alias("risk_rank"), "masked")
    newest = found.groupBy("root", "path").agg(F.max(x).alias("x"), F.bool_or(F.col("value_hash").isNotNull()).alias("held"))
    return _by_batch(newest.where("held").select("root", "path", "x.*"), log, NEWEST, checkpoint)


def changes_stream(spark: SparkSession, newest: str, log: str, checkpoint: str, files_per_trigger: int = 1000) -> DataStreamWriter:
    """The changes of secrets by every batch of newest versions, appended to log."""
    rows = spark.readStream.schema(NEWEST).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(newest)
    changes = rows.groupBy("root", "path").applyInPandasWithState(_changes, DELTAS, _STATE, "append", GroupStateTimeout.NoTimeout)
    return changes.writeStream.format("parquet").outputMode("append").option("path", log).option("checkpointLocation", checkpoint)


def _counted(delta: Column) -> list[Column]:
    return [F.sum(F.when(F.col("risk_rank") == i, delta).otherwise(0)).alias(f"n{i}") for i in range(len(RISKS))]


def counts_stream(spark: SparkSession, log: str, table: str, checkpoint: str, files_per_trigger: int = 1000) -> DataStreamWriter:
    """How often each secret is held, by risk of the file: the secrets that a batch of changes touches are written to
    table/batch_id=n. The masked form hangs on the secret alone."""
    deltas = spark.readStream.schema(DELTAS).option("maxFilesPerTrigger", files_per_trigger).parquet(log)
    counts = deltas.groupBy("root", "value_hash").agg(F.max("masked").alias("masked"), *_counted(F.col("delta").cast("long")))
    return _by_batch(counts, table, _COUNTS, checkpoint)


def _folders(spark: SparkSession, table: str) -> dict[int, str]:
    """Batches of a table that were written to the end, by number."""
    top = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return {}
    found = {}
    for status in files.listStatus(top):
        kind, _, number = status.getPath().getName().partition("=")
        done = files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
        if kind in ("batch_id", "base") and number.lstrip("-").isdigit() and done:
            found[kind, int(number)] = status.getPath().toString()
    base = max((n for kind, n in found if kind == "base"), default=None)
    kept = {n: p for (kind, n), p in found.items() if kind == "batch_id" and (base is None or n > base)}
    return kept | ({base: found["base", base]} if base is not None else {})


def _last(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    rows = None
    for n, path in sorted(_folders(spark, table).items()):
        if upto is None or n <= upto:
            one = spark.read.schema(_COUNTS).parquet(path).withColumn("batch_id", F.lit(n).cast("long"))
            rows = one if rows is None else rows.unionByName(one)
    rows = rows if rows is not None else spark.createDataFrame([], f"{_COUNTS}, batch_id long")
    held = [f"n{i}" for i in range(len(RISKS))]
    last = rows.groupBy("root", "value_hash").agg(F.max_by(F.struct("masked", *held), "batch_id").alias("x"))
    return last.select("root", "value_hash", "x.*")


def running_repeats(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """root, value_hash, masked, risk, count of the secrets that are the best hit of two files or more, after all batches
    or after batch upto (where that hasn't been folded into the base yet)."""
    counts = [F.col(f"n{i}") for i in range(len(RISKS))]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    risk = F.coalesce(*[F.when(F.col(f"n{i}") > 0, RISKS[i]) for i in reversed(range(len(RISKS)))])
    return _last(spark, table, upto).select("root", "value_hash", "masked", risk.alias("risk"), total.alias("count")).where("count >= 2")


def last_batch(spark: SparkSession, table: str) -> int | None:
    return max(_folders(spark, table), default=None)


def compact(spark: SparkSession, table: str) -> None:
    """Fold all batches into one base. Secrets that nobody holds any more go. The base counts once it has been written to
    the end; only then the folders it replaces are removed, so that a stop in between does no harm. Readers that began
    before should be done, as after any rewriting of a table."""
    held = _folders(spark, table)
    if len(held) < 2:
        return
    to = max(held)
    counts = " + ".join(f"n{i}" for i in range(len(RISKS)))
    _last(spark, table).where(f"{counts} > 0").write.mode("overwrite").parquet(f"{table}/base={to}")
    for path in held.values():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def advance(spark: SparkSession, landing: str, store: str, **options) -> int | None:
    """Take up all that has landed since the last call (streams that run until nothing is left) and return the number of
    the last batch. store holds the newest versions, the changes, the table and the checkpoints."""
    streams = (
        lambda: newest_stream(versions_stream(spark, landing), f"{store}/newest", f"{store}/checkpoint/newest", **options),
        lambda: changes_stream(spark, f"{store}/newest", f"{store}/changes", f"{store}/checkpoint/changes"),
        lambda: counts_stream(spark, f"{store}/changes", f"{store}/counts", f"{store}/checkpoint/counts"),
    )
    for stream in streams:  # each reads what the one before has written
        stream().trigger(availableNow=True).start().awaitTermination()
    return last_batch(spark, f"{store}/counts")
