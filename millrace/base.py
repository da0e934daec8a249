"""What all operators share: reading tables, spreading work, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows per executor slot below which a broadcast side counts as bounded; see bounded().
BROADCAST_ROWS = 200_000
#: Python-heavy stages want several tasks per core, so that one slow task cannot hold up the rest.
TASKS_PER_CORE = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a directory; filters and column pruning reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows to several tasks per core if the scan yields fewer; large scans stay as they are.

    Meant for unique keys before CPU-heavy Python, where a small file would otherwise be one task.
    """
    want = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want, *keys) if df.rdd.getNumPartitions() < want else df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> list | None:
    """The rows of a small table for the driver, or None if it holds more than `rows`."""
    got = df.limit(rows + 1).collect()
    return None if len(got) > rows else got


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut through the folder that spark.checkpoint.dir names.

    Only where that setting is absent (tests, local runs) a folder of this machine is taken.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="millrace-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(where)
    return df.checkpoint()


SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in SHIPPED:
        root, to = Path(__file__).parent, Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
        SHIPPED.add(sc.applicationId)
    return spark
