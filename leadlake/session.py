"""Settings read from, or given to, the Spark session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches, as named in ``spark.checkpoint.dir``.

    Without that setting, a session on a ``local`` master (a test) gets a temporary folder,
    and any other master a folder in the warehouse. A warehouse on a local disk is refused
    there: each executor would write to its own machine, and later reads would find nothing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="leadlake-")
        else:
            folder = _warehouse_folder(spark)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _warehouse_folder(spark: SparkSession) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file":
        raise ValueError(
            "spark.checkpoint.dir is not set and the warehouse is on a local disk; "
            "name a folder that all executors share in spark.checkpoint.dir"
        )
    return f"{files.makeQualified(path).toString().rstrip('/')}/leadlake-stored"


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps neither recompute it nor guess its size: Catalyst sees the size of the
    files and broadcasts the table only when it is small. Unlike a local checkpoint the
    table outlives a lost executor.
    """
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
