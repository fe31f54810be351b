"""Tables that a job writes for its own later steps, and pointers that name which of them holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse on a cluster, a temporary
    folder on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp(prefix="treeledger-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def own_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/written/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, so that several steps read it without working it out again."""
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """What the newest file of a pointer's folder names. Files are numbered and empty: the name says all, so that one is
    whole as soon as it is there."""
    where, files = _at(spark, path)
    if not files.exists(where):
        return None
    names = [s.getPath().getName() for s in files.listStatus(where)]
    found = sorted((int(n), v) for n, _, v in (x.partition("-") for x in names if not x.startswith(("_", "."))) if n.isdigit() and v)
    return found[-1][1] if found else None


def turn_pointer(spark: SparkSession, path: str, value: str) -> None:
    """Let a pointer name value (letters, digits, - and _). An empty file of that name is made under the next number; older
    ones stay, so that a reader always finds one. Of two writers at once one holds, by number, then by name."""
    if not value or not value.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a pointer can't name {value!r}")
    where, files = _at(spark, path)
    files.mkdirs(where)
    numbers = [int(n) for n in (s.getPath().getName().partition("-")[0] for s in files.listStatus(where)) if n.isdigit()]
    made, _ = _at(spark, f"{path}/{max(numbers, default=-1) + 1}-{value}")
    files.create(made, False).close()
