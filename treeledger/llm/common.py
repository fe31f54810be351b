"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of narrow ids that may be broadcast; beyond it the same join shuffles.
BROADCAST_IDS = 500_000
#: Rows and bytes that a Python task looks at together; a longer text is looked at by itself.
SLICE_ROWS, SLICE_BYTES = 500, 1_000_000
#: Bytes of a batch between the JVM and Python, set where the session has Spark's own default.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where none is set, one in the warehouse on a
    cluster and a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = tempfile.mkdtemp(prefix="treeledger-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/treeledger"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of the tables that each open scratch block of this thread (or task of an event loop) has written.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialized inside the block are removed when it ends, but for those written with keep: these go with
    the block around it, if there is one. Blocks that run side by side in other threads know nothing of each other."""
    mine: list[str] = []
    token = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(token)
        for path in mine:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = _open.get()[:-1] if keep else _open.get()
    if at:
        at[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most SLICE_ROWS rows and about SLICE_BYTES bytes of text."""
    size = None
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            n = pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype("int64")
            size = n if size is None else size + n
    at, held = 0, 0
    for i in range(batch.num_rows):
        more = int(size[i]) if size is not None else 0
        if i > at and (i - at >= SLICE_ROWS or held + more > SLICE_BYTES):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += more
    if batch.num_rows > at:
        yield batch.slice(at)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str) -> DataFrame:
    """Python work on rows, in tasks: make() is called once a task and gives a function from a few rows (tuples of df's
    columns) to any number of output rows. Arrow batches are bounded by bytes, and a slice at a time is turned into
    Python values, so that long texts don't add up; what comes out of a slice is a batch of its own."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        work = make()
        for b in batches:
            for part in _slices(b):
                out = work(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that no column added beside it can clash with one of theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpacked(columns: list[str], name: str = "row", **instead: Column) -> list[Column]:
    """The columns of a packed struct, some of them replaced."""
    return [instead.get(c, F.col(name).getField(c)).alias(c) for c in columns]


def row_key(*cols: Column) -> Column:
    """128 bits that stand for the values of a row, nulls told apart from other values."""
    cols = [x for c in cols for x in (c, c.isNull())]
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def few(ids: DataFrame, bound: int = BROADCAST_IDS) -> bool:
    """Whether a table of narrow ids has at most bound rows. ids should be materialized."""
    return ids.count() <= bound


def only(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a table of ids, broadcast if its counted rows are few, shuffled otherwise."""
    return df.join(F.broadcast(ids) if few(ids) else ids, on, how)


def as_text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 5. Fold 0 is held out. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null counts 0."""
    return F.regexp_count(as_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
