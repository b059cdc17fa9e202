"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast after it was counted.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or, where that is unset (local runs), a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="nightjar-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage where executors may be lost."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def skipping(bad_files: bool) -> dict[str, str]:
    """Reader options that leave out files which are corrupt or gone meanwhile."""
    return {"ignoreCorruptFiles": str(bad_files).lower(), "ignoreMissingFiles": str(bad_files).lower()}


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay below the bound."""
    return F.broadcast(df) if df.count() <= most else df
