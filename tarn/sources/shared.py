"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of this machine; a cluster has none that its executors could read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, application = spark.sparkContext.master, spark.sparkContext.applicationId
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="tarn-")
    return _OWN[application]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``; any store that Spark reads will do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tarn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``written`` wrote, once nothing reads it any more."""
    path = df.__dict__.get("tarn_path")
    if path:
        fs, target = file_system(df.sparkSession, path)
        fs.delete(target, True)
