"""A training corpus from `documents`: five stages, each one of the operators of tracewell.llm.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns the rows it keeps, with the columns
of documents; the last one also numbers the copies that the mix takes of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, mixing, neardup, quality, toxicity
from tracewell.llm.common import cut, slot_split, unpacked


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.7 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_scores(docs, model).where("score >= 0.7")
    return scored.select(*unpacked(scored, docs.columns, "text"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives less than 0.5."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs, model).where("score < 0.5")
    return scored.select(*unpacked(scored, docs.columns, "text"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents linked by five-word shingles and a similarity of 0.8 or more."""
    dropped = cut(neardup.near_duplicates(docs, width=5, numerator=80, denominator=100).where("not kept").select("doc_id").distinct())
    some, others = slot_split(docs, F.col("doc_id"), dropped, F.col("doc_id"))  # so that few texts are dealt out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return some.join(dropped, "doc_id", "left_anti").select(*columns).unionByName(others.select(*columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=True)
    clean = found.where(F.size("spans") == 0)
    return clean.select(*unpacked(clean, docs.columns, "text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken of a document."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("minhash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]

#: Trained stages aren't SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
