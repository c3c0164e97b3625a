"""The thin queries opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import books_sha256, compress
from .common import held_out, table
from .decontam import contaminated
from .html import html_text
from .langid import language_id
from .linededup import line_dedup
from .lmscore import lm_scores
from .mixing import mix
from .ngramjoin import jaccard_components
from .packing import pack
from .substring import substring_dedup
from .topk import exact_topk, quantised
from .toxicity import toxicity
from .trie import prefix_trie, rebuilt, turns


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings"), 64.0)
    return exact_topk(spark, v, v.where("id % 20 = 0"), k=20, slices=4)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"), ("page_id",))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(spark, table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return language_id(spark, docs, ~F.col("held_out"), ("doc_id", "held_out"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(spark, docs.withColumn("held_out", held_out()), labels, ~held_out(), ("doc_id", "held_out"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(spark, table(spark, sf_dir, "documents"), k=13)
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, table(spark, sf_dir, "documents"), held_out(mod=7, rest=2))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(spark, table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, books = compress(spark, table(spark, sf_dir, "embeddings"))
    return got.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, *rebuilt(spark, turns(spark, table(spark, sf_dir, "conversations"))))


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_topk, op2_html_text, op3_line_dedup, op4_language_id, op5_packing, op6_decontamination, op7_toxicity, op8_substring_dedup, op9_ngram_jaccard, op10_lm_score, op11_mixing, op12_vector_codes, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
