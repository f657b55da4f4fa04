"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where none is set, and in local mode alone, a folder of this process."""
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="voxmill-"))
    return context.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """df written once and read back: later steps neither repeat its plan nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table behind a result of materialise; only for one that nothing will read again."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark can write to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
