"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder, but only if all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lafz-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, codec: str = "zstd", batch_rows: int | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again.

    A lost executor then costs a read of that table, not the work behind it. The table stays until discard() or until
    the application's folder under spark.checkpoint.dir is removed. batch_rows: rows of an Arrow batch during this
    write, for passes over whole texts, whose batches are held in both the JVM and Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lafz-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(batch_rows))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.lafz_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once all that reads them is written."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.lafz_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
