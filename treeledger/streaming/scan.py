"""The secret scan over landing contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from treeledger.operators import secrets

CONTENTS = "root string, path string, text string"


def contents_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of (root, path, text) as they land in folder."""
    return spark.readStream.schema(CONTENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scan_stream(contents: DataFrame, out: str, checkpoint: str, **options) -> DataStreamWriter:
    """Findings of every new batch, appended to out once. A file's findings come from its own row: the stream needs no
    state, and a restart goes on after the last batch that was committed."""
    found = secrets.findings(contents, **options)
    return found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
