"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dup, packing, pii, quality
from tidemark.llm.job import saved
from tidemark.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly taught scorer finds good and that are not toxic stay."""
    return quality.kept(docs).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (80 of 100 shingles) stays, the one with the smallest id.

    A document is its id and text: rows equal in both are one, and of several
    texts under one id each is judged for itself.  Empty texts are alike to
    nothing and stay.
    """
    named = docs.withColumn("_row", F.expr("md5(concat(coalesce(cast(doc_id as string), '-'), ':', coalesce(text, '')))"))
    found = near_dup.near_duplicates(named.selectExpr("struct(doc_id, _row) as _id", "text"), "_id", percent=80)
    found = found.where("kept").selectExpr("_id._row as _row").distinct()
    return named.join(found, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items).where("not contaminated").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its personal data masked and counted anew."""
    found = pii.find(docs, keep_text=True)
    masked = found.withColumn("text", F.expr(pii.masked("text", "concat(base, added)")))
    return masked.withColumn("n_chars", F.expr("cast(length(text) as bigint)")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality", good_texts),
    ("near_duplicates", distinct_texts),
    ("decontamination", uncontaminated),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are saved for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# The stages cannot be said in SQL; tests compare them with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
