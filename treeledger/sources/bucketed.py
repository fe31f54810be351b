"""Contents stored in buckets of (root, path): what is allowed meets them bucket by bucket, and the texts stay in place."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("root", "path")


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def write_bucketed(contents: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """contents (root, path, others) as a bucketed table of that name at path, sorted in each bucket. Each bucket is written
    by one task as one file, so buckets should be as many as keep a bucket within a task's memory."""
    if buckets < 1:
        raise ValueError(f"buckets must be 1 or more, not {buckets}")
    dealt = contents.repartition(buckets, *KEY)
    dealt.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).mode("overwrite").saveAsTable(_checked(name))
    return contents.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """The table again in a session whose catalog doesn't know it: buckets must be as they were written."""
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(KEY)
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_checked(name)} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def allowed_contents(stored: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of a bucketed table whose (root, path) allowed lists. allowed, which is narrow, is dealt into the table's
    buckets (or broadcast, where Spark finds it small); the table's rows are not moved. Repeated rows of allowed count
    once."""
    return stored.join(allowed.select(*KEY).distinct().hint("merge"), list(KEY), "left_semi")


def allowed_with(stored: DataFrame, allowed: DataFrame) -> DataFrame:
    """As allowed_contents, with the other columns of allowed, which must name each (root, path) once."""
    more = [c for c in allowed.columns if c not in KEY]
    clash = set(more) & set(stored.columns)
    if clash:
        raise ValueError(f"both tables hold {sorted(clash)}")
    return stored.join(allowed.hint("merge"), list(KEY)).select(*[F.col(c) for c in stored.columns], *more)
