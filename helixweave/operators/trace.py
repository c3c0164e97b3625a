"""Paths of pairs in linear memory, one pair a row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from helixweave.functions import kernels as K
from helixweave.functions import linear
from helixweave.functions.scoring import Scores


def linear_paths(pairs: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """Columns of pairs but the texts, with ops of a global alignment found in linear memory, and their score."""
    keys = [f for f in pairs.schema.fields if f.name not in ("a", "b")]

    def run(batches):
        for batch in batches:
            texts = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            ops = [linear.path(K.codes(x or ""), K.codes(y or ""), sc=scores) for x, y in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keys), pa.array(ops, pa.string()), pa.array([linear.score_of(o, scores) for o in ops], pa.int64())], [*(f.name for f in keys), "ops", "score"])

    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join([*(f"`{f.name}` {types[f.name]}" for f in keys), "ops string", "score long"]))
