"""Places in an order, for tables of any size and roots of any share: rows are dealt by range of the order's keys, so that a
part holds a stretch of it, and the counts of the parts before a part are what its own rows start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions import paths as P
from treeledger.sources.store import written


def ranked(df: DataFrame, keys: list[Column], position: str = "position", within: str | None = None) -> DataFrame:
    """df with its rows' places, from 1, by keys; with within, from 1 in every value of that column, which comes before the
    keys. Rows are sorted in parts, none of which must hold a whole group; only a row a part, and one a group, is put in
    sequence. Rows that tie on all keys are numbered in any order, and lie in one part: keys should tell them apart.

    The sorted rows are written once, as bounds of ranges are drawn from a sample and would differ if worked out again."""
    names = [f"_k{i}" for i in range(len(keys))]
    first = [F.col(within)] if within else []
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    order = [*first, *[F.col(n) for n in names]]
    parts = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of a row in its part is the low half of the id
    parts = parts.withColumn("_id", F.monotonically_increasing_id()).drop(*names)
    parts = parts.select(*df.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row"))
    parts = written(parts, "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = parts.join(F.broadcast(offsets), "_part")  # a row a part
    place = F.col("_before") + F.col("_row")
    if within is None:
        return rows.select(*df.columns, (place + 1).alias(position))
    # a group's first place: the least of its rows' places, found part by part before any shuffle
    starts = parts.groupBy(within, "_part").agg(F.min("_row").alias("_row")).join(F.broadcast(offsets), "_part")
    starts = starts.groupBy(F.col(within).alias("_g")).agg(F.min(place).alias("_first"))
    rows = rows.join(starts, rows[within].eqNullSafe(starts["_g"]))
    return rows.select(*df.columns, (place - F.col("_first") + 1).alias(position))


def in_order(df: DataFrame, first: Column | None = None, position: str = "position") -> DataFrame:
    """Rows (root, path, ...) with their place in a root's presentation order, from 1: by first (descending) if given, then
    by path in component order."""
    keys = [*([] if first is None else [-first]), P.parts("path"), F.col("path")]
    return ranked(df, keys, position, within="root")
