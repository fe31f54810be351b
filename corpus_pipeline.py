"""A training corpus from documents: toxic texts go, near-duplicates and benchmark leaks go, personal data is masked and
the sources are mixed to their target weights. Each stage works on all that the one before it kept.

Cases, in every stage: a null text counts as the empty text and stays null; empty texts are no duplicates of each other,
hold no benchmark item and no personal data, and the mix takes none of their 0 words. A null doc_id is never a duplicate;
rows with it are judged by their text. Repeated rows: toxicity, decontamination and masking treat each alike,
near_dedup keeps one of the rows that share a doc_id, the mix takes each by itself. Ties between copies go to the least doc_id.
An empty table gives an empty one. Texts of any length are read whole. Other columns go through, whatever their names, but
for those that the last stage adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import decontaminate, mixing, near_dedup, pii, toxicity
from treeledger.llm.common import materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, fitted on the labelled documents of sf_dir, rejects go. Without labels of both
    classes the score is the one class's share."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return near_dedup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of sf_dir's benchmark, with few edits, go; an empty benchmark drops nothing."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars, where there is one, follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        n = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with what it takes of them: the columns of docs, size, source_size, target,
    taken and shards."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the network of the first stage; tests/llm/test_pipeline.py compares each stage, and run(), with plain
#: Python on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
