"""Table functions for SQL text: ``SELECT * FROM align_score(TABLE(pairs), '3', '+')``."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeResult

from .scoring import EDGES

#: Pairs that one kernel call takes together.
BATCH = 2048


def _align_score():
    """The function's class. It travels by value: the process that analyses SQL need not find this package.

    Workers of table functions do not get the session's search path either, so they look where the driver found it; on
    a cluster, where the package comes with the job or the image, that does no harm.
    """
    rules, most, root = tuple(EDGES), BATCH, str(Path(__file__).resolve().parents[2])

    class AlignScore:
        """Columns of a table of pairs but the texts a and b, with score, end_i and end_j; start and end name the edge rules."""

        @staticmethod
        def analyze(pairs, start, end):
            if not pairs.isTable or not {"a", "b"} <= set(pairs.dataType.names):
                raise ValueError("the first argument is a table with the columns a and b")
            if start.value not in rules or end.value not in rules:
                raise ValueError(f"start and end are among {' '.join(rules)}")
            schema = StructType([f for f in pairs.dataType.fields if f.name not in ("a", "b")])
            for name in ("score", "end_i", "end_j"):
                schema = schema.add(name, LongType())
            return AnalyzeResult(schema)

        def __init__(self):
            self.rows, self.ends = [], ("*", "*")

        def flush(self):
            if root not in sys.path:
                sys.path.append(root)
            from helixweave.functions import kernels as K
            from helixweave.functions.scoring import Edges

            a, b = ([K.codes(r[c] or "") for r in self.rows] for c in ("a", "b"))
            got = K.best_scores(a, b, Edges(*self.ends)).tolist()
            rows, self.rows = self.rows, []
            for r, x in zip(rows, got, strict=True):
                yield (*(v for c, v in r.asDict().items() if c not in ("a", "b")), *x)

        def eval(self, pairs, start, end):
            self.ends = start, end
            self.rows.append(pairs)
            if len(self.rows) >= most:
                yield from self.flush()

        def terminate(self):
            if self.rows:
                yield from self.flush()

    return AlignScore


def register(spark: SparkSession) -> None:
    """Makes ``align_score(TABLE(pairs), start, end)`` known to SQL text of the session."""
    spark.udtf.register("align_score", udtf(_align_score()))
