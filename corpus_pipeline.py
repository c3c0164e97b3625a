"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Edge cases, in every stage: rows without doc_id pass through (no id, no decision about it), as do null and
empty texts; texts of any length are read whole; rows that repeat are decided alike, so both stay or both
go; an id with several texts is one document, which goes as a whole where one of its texts must; an empty
table of documents gives an empty result, an empty table of labels or items rejects nothing; columns
beside doc_id and text keep names and values, whatever they are called (n_chars follows the text).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave.llm.common import held_out, shared_dir, table
from helixweave.llm.decontam import contaminated
from helixweave.llm.linededup import line_dedup
from helixweave.llm.ngramjoin import jaccard_components
from helixweave.llm.packing import pack
from helixweave.llm.toxicity import toxicity


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return docs.join(ids, "doc_id", how).select(*[F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of the training split, does not call toxic."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    scored = toxicity(spark, whole, table(spark, sf_dir, "labels"), ~held_out(), ("_row",))
    return scored.where("predicted = 0").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned lines leave the later document; a document that loses all its lines goes."""
    # the other columns travel under names of their own
    own = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    got = line_dedup(spark, docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()]))
    got = got.where((F.col("n_lines_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != ""))
    if "n_chars" in own:
        got = got.withColumn(own["n_chars"], F.when(F.col("n_lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col(own["n_chars"])))
    return got.select(*[F.col(k).alias(c) for c, k in own.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles of similarity 0.8 connect, the one with the smallest id.

    Near copies come here without the lines that line dedup took from them: what is left of such a copy are its
    own lines, which are not similar to the document it was copied from.
    """
    got = jaccard_components(spark, docs, n=5, percent=80)
    return _only(docs, got.where("component_id < doc_id").select("doc_id").distinct(), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    return _only(docs, contaminated(spark, docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Trained weights and the boundaries' dynamic programming are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}-{name}")
        docs = spark.read.parquet(f"{top}/{i}-{name}")
    return docs
