"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm import binary, bpe, jaccard, lines, merkle, packing, pii, quality, substrings, syncmers, templates, toxicity, vectorcodes
from quirewise.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Files of the public tokenizers; any path that all executors can read will do.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir), n=4, percent=85)


@query
def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), max_rows=8000))


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir), WORD_VOCABULARY, capacity=4096, end_id=1)


@query
def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir))


@query
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.write_training_order(table(spark, sf_dir), WORD_VOCABULARY, key=20240229)


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN, keep_ids=False)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.apply_policy(quality.ledger(table(spark, sf_dir)), "web-1")
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.mask_of("base-1"))) != 0
    return kept.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits"
    )


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and checked proof of every document; nulls, ties and empty tables as in ``merkle.manifest``."""
    return merkle.manifest(table(spark, sf_dir))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every finite vector; other lengths, ties and empty tables as in ``vectorcodes.compress``."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


@query
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; nulls, repeated rows and empty tables as in ``templates.extract``."""
    return templates.extract(table(spark, sf_dir, "pages"))
