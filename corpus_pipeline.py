"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it
kept.  All but the last return the columns of ``documents``; a stage that changes
texts also sets ``n_chars`` anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm import jaccard, lines, packing, pii, quality
from quirewise.llm.common import stage_table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality.kept_documents(docs, "web-1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay where they stand first; documents left without a word go."""
    marks = lines.keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True)
    kept = lines.apply_bitmaps(docs, marks).filter((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return _with_length(kept.select(*(F.col(f"`{c}`") for c in docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents alike (five words, 0.8) one row: the one with the smallest id.

    Every row is a document of its own, also where ids are equal or null, so of equal
    rows one stays and different texts under one id both do.  Rows without an id come
    after all others; under one id, or without one, hashes of the text and then of the
    row decide.  Documents without words are like no other and all stay.
    """
    # Numbers are written once, so they are the same in every read; the row is one value, so its names meet none of ours.
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row"))
    rows = stage_table(rows, "near-duplicate-rows")
    found = jaccard.link_components(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), n=5, percent=80)
    found = found.select(F.col("doc_id").alias("number"), "component_id")
    hashed = [F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # Spark hashes no maps
    place = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row.text"), F.xxhash64(*hashed), "number")
    order = rows.select("number", place.alias("place"))
    keep = found.join(order, "number").groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.number").alias("number"))
    return rows.join(keep.hint("merge"), "number", "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    return _with_length(pii.mask_pii(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizer and random field are beyond SQL; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
