"""State of a resumable run, kept beside its results; a run of other inputs is refused."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class RunState:
    def __init__(self, spark: SparkSession, path: str, info: dict):
        self.spark, self.path, self.info = spark, path, info

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _rows(self) -> list[dict]:
        fs, p = self._files()
        if not fs.exists(p):
            return []
        # one line for each step
        return sorted((json.loads(r[0]) for r in self.spark.read.text(self.path).collect()), key=lambda r: r["done"])

    def load(self) -> tuple[int, int]:
        """(steps done, best score); (0, 0) for a new run."""
        rows = self._rows()
        if not rows:
            return 0, 0
        if rows[-1]["info"] != self.info:
            raise ValueError(f"{self.path} belongs to another run: {rows[-1]['info']}")
        return rows[-1]["done"], rows[-1]["best"]

    def steps(self) -> list[dict]:
        """What was noted of each step, in order."""
        return [r.get("notes", {}) for r in self._rows()]

    def save(self, done: int, best: int, notes: dict | None = None) -> None:
        # appended, so that a failure while writing leaves the state before
        line = json.dumps({"info": self.info, "done": done, "best": best, "notes": notes or {}})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(self.path)
