"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character class of the separators of words, as a regular expression.
SEPARATORS = r"[\x20\x09-\x0D]"
#: Most rows of a side that may be broadcast, and most bytes a row of it may hold on average.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where
    that is unset (local tests), a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="nightjar-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the
    lineage at a place that outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Remove the files of a table made by ``materialize`` that nothing reads any more."""
    if df is None:
        return
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh_heaps(spark: SparkSession) -> None:
    """Let the executors collect garbage and return the heap that earlier work has touched, and keep Arrow batches at 16 MB.

    Between stages of one application: an executor's heap otherwise stays as large as the largest stage made it, while the next
    stage needs its memory for Python workers and Arrow buffers, which lie outside the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def letters_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_PLAIN = {"Project", "Filter", "LogicalRelation", "Relation", "LocalRelation", "LogicalRDD", "Range", "SubqueryAlias", "View"}


def with_row_ids(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a unique long per row that is the same each time the plan is run.

    The ids number the rows of each input split; they repeat exactly as long as the
    plan is a scan with projections and filters.  Any other plan (one with a shuffle,
    whose row order may change when a lost part is computed again) is written to the
    shared folder first.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in _PLAIN and plan.children().size() == 1:
        plan = plan.children().head()
    if plan.nodeName() not in _PLAIN:
        df = materialize(df, "rows")
    return df.withColumn(name, F.monotonically_increasing_id())


def filtered(docs: DataFrame, choose) -> DataFrame:
    """``docs`` reduced to some of its rows, with exactly its own columns.

    ``choose`` gets ``docs`` with a row id ``_row`` and returns the rows that stay; a column of that
    name in ``docs`` is set aside meanwhile.
    """
    own = [c for c in docs.columns if c.lower() == "_row"]
    numbered = with_row_ids(docs.withColumnRenamed(own[0], "_row_of_input") if own else docs)
    kept = choose(numbered).drop("_row")
    return (kept.withColumnRenamed("_row_of_input", own[0]) if own else kept).select(*[F.col(f"`{c}`") for c in docs.columns])
