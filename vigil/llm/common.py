"""Shared pieces of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only where that is unset and all runs on this
    machine a local one is set; on a cluster that is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jdir.get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that lost executors cost no recomputation and reruns agree."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: smaller than a checkpoint for large results."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def hash_bucket(n: int | Column, *cols: str | Column) -> Column:
    """0 to n - 1 from an MD5 of the columns, so that DuckDB can say the same."""
    text = F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(n) if isinstance(n, int) else n)


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row within keys, by bucket and then order, without sorting a key in one task.

    Rows are numbered within (keys, bucket); the buckets' counts, prefix-summed, give each bucket's first rank.
    keys must not be null. Ties of equal rows fall in any order.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn("_within", F.row_number().over(within) - 1)
    return rows.join(first, [*keys, "_bucket"]).withColumn(name, F.col("_first") + F.col("_within")).drop("_bucket", "_first", "_within")
