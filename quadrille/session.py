"""Session helpers: the shared folder, tables that cut lineage, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["shared_dir", "cut", "release", "bounded_batches"]

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests), where neither that setting nor a checkpoint directory exists, is
    a temporary folder made and registered; on a cluster that raises an error, as executors
    would write where nobody else reads.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "table", rows: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan starts afresh from replicated storage, so a lost executor costs a re-read
    and not a recomputation, and readers get column pruning. ``rows`` bounds the rows of a file (0: no
    bound), for large ones: readers take thousands of rows of a file at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut` has written in this process, and say how many.

    For the end of a job: results that read from them must have been written by then.
    """
    n = len(_written)
    for path in _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.clear()
    return n


def bounded_batches(spark: SparkSession, rows: int | None = 2048, mb: int = 8) -> None:
    """Bound the Arrow batches that Python workers get, by rows (None: as they are) and by bytes."""
    if rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)
