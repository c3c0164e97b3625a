"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def workers_find_package(spark: SparkSession) -> SparkSession:
    """Python workers import this package from where the driver found it.

    On a cluster the package comes with ``--py-files`` or the image; the entry then does no harm.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir.

    In local mode, where none is named, it is a temporary one that goes with the process.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or getattr(work_dir, "own", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="work-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        top = work_dir.own = f"file://{own}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
