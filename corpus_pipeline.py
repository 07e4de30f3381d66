"""A corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents; the
last adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from sparkloom.llm.common import keep_rows, lower_ascii, text_or_empty
from sparkloom.llm.queries import first_half
from sparkloom.runtime import cut, ensure_checkpoint_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; the model is fitted on labelled documents as in op9."""
    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    return docs.where(language_id.classifier(model)(docs["text"].cast("string"))["accepted"])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    kept = exact_dedup.exact_dedup(docs, first_half()).where("kept").select("doc_id", "text_sha256")
    return keep_rows(docs, cut(kept), "doc_id", F.sha2(lower_ascii(text_or_empty(docs["text"])), 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component; of several with that id, the smallest digest."""
    return keep_rows(docs, cut(simhash.one_each(docs)), "doc_id", F.sha2(text_or_empty(docs["text"]), 256))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, target, words taken, whole copies and the rest of a part."""
    return mixing.mix(docs, keep=True).where("mix_taken > 0")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Compression, SimHash, alignment and Newton steps are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
