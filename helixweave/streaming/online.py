"""Alignment of arriving sequences, and columns handed from part to part.

``score_stream`` joins a stream of sequences with a static set and scores each pair as it arrives;
``best_so_far`` keeps, per target, the best score seen. ``split_columns`` aligns one sequence against
the parts of another: the last column of a part is the first column of the next, as rows of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave.functions.scoring import Edges, Scores
from helixweave.operators.align import align_score
from helixweave.operators.pairs import meet_all
from helixweave.operators.wavefront import align_large


def score_stream(stream: DataFrame, targets: DataFrame, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """(seq_id, target_id, score, end_i, end_j) for a streaming (seq_id, seq) and a static (target_id, target).

    Every arriving sequence meets every target.
    """
    s, t = stream.select("seq_id", F.col("seq").alias("a")), targets.select("target_id", F.col("target").alias("b"))
    return align_score(meet_all(s, t), edges, scores)


def best_so_far(scored: DataFrame) -> DataFrame:
    """Running best of each target (complete or update mode)."""
    return scored.groupBy("target_id").agg(F.max(F.struct("score", (-F.col("seq_id")).alias("seq_id"))).alias("x")).select("target_id", F.col("x.score").alias("score"), (-F.col("x.seq_id")).alias("seq_id"))


def watch(spark: SparkSession, path: str, targets: DataFrame, checkpoint: str, table: str) -> object:
    """Starts scoring of Parquet files of (seq_id, seq) that arrive in ``path``, into an in-memory table."""
    stream = spark.readStream.schema("seq_id long, seq string").parquet(path)
    return score_stream(stream, targets).writeStream.format("memory").queryName(table).option("checkpointLocation", checkpoint).outputMode("append").start()


def score_arrived(spark: SparkSession, path: str, targets: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Scores all Parquet files of (seq_id, seq) that are in ``path`` now and were not scored before; the rows of ``out``."""
    stream = spark.readStream.schema("seq_id long, seq string").parquet(path)
    scored = score_stream(stream, targets)
    scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


def split_columns(spark: SparkSession, a: str, b: str, tile: int, path: str, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """Best cell of each part of b (a column of blocks), with borders handed on from part to part."""
    return best_of_parts(align_large(spark, a, b, len(a), len(b), tile, path, edges, scores))


def best_of_parts(blocks: DataFrame) -> DataFrame:
    """(part, score, i, j): the best cell of each column of blocks."""
    best = F.max(F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("x")
    return blocks.groupBy(F.col("bx").alias("part")).agg(best).select("part", "x.score", (-F.col("x.i")).alias("i"), (-F.col("x.j")).alias("j"))
