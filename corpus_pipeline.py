"""Corpus preparation in five stages; each takes (spark, docs, sf_dir) and its result is written and read as the next one's docs."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, decontaminate, jaccard_join, line_dedup, packing, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks go. It scores and filters in one pass, as the score is a column of the row."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, by five-word shingles with a Jaccard index of 0.8 or more, the document of the least id stays."""
    found = jaccard_join.join(docs, k=5, threshold=Fraction(8, 10))
    return common.without(docs, found.filter("component_id <> doc_id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; it searches and filters in one narrow pass."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", benchmark), ("packing", packed)]
#: The classifier, the tokenizer and the sketches are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = common.Tables(spark)
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
