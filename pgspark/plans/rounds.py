"""Writes the state of a loop once per round, so that plans and lineage stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one in a local session that names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-rounds-", dir="/tmp"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Rows of a partition that is dealt by ``dealt``.
PART_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys in as many partitions as ``rows`` ask for, so that what a task holds of it does not grow with the table."""
    return df.repartition(max(1, -(-rows // PART_ROWS)), *keys)


def discard(*rounds: DataFrame | None) -> None:
    """Remove the folders of earlier rounds; tables that were not written by ``materialise`` are passed over."""
    for df in rounds:
        if getattr(df, "_written", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)
