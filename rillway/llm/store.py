"""Shared places for intermediate results.

A cluster names the folder in spark.checkpoint.dir; executors and driver all reach it. Only where it is
unset (tests, local mode) a folder under the warehouse is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rillway-checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """Evaluates once and cuts the lineage with a reliable checkpoint, which survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches held to BATCH_BYTES in its session, so that workers' memory does not
    follow the length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results wherever Spark's file systems hold it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
