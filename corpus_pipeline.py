"""A training corpus from the table documents: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, with n_chars of the new text.
"""

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import public_tokenizers  # noqa: E402

from spanwood.llm import quality  # noqa: E402
from spanwood.llm.decontaminate import drop_leaks  # noqa: E402
from spanwood.llm.line_dedup import drop_repeated_lines  # noqa: E402
from spanwood.llm.near_dedup import near_duplicates  # noqa: E402
from spanwood.llm.packing import pack_documents  # noqa: E402
from spanwood.llm.store import written  # noqa: E402

SIMILAR = 80  # percent of shared shingles from which documents are near duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only."""
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; rows with a null id stay."""
    kept = near_duplicates(docs, percent=SIMILAR).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.where("doc_id IS NOT NULL").join(kept.hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences."""
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None  # SQL can't express the classifier


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
