"""The folder that the driver and all executors share."""

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineStateError


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one where it names none, which only a local master may do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineStateError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again, so that whatever uses it sees the same rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
