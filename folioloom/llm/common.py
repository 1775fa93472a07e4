"""What the training-data operators share: inputs, the shared folder, staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word, wherever an operator counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that Spark hands a Python worker at once, whatever the number of rows: long texts come in small batches.
BATCH_BYTES = 4 << 20


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed on them, and bound what they hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='folioloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioloom-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where ``df`` has columns by these names."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none. Each word shrinks to one character, white space goes."""
    ones = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(ones, " \t\n\x0b\f\r", "")).cast("long")


def id_hash(doc_id: Column) -> Column:
    """A 60-bit hash of an id, the same in any SQL engine that has md5; a null id counts as the text 'null'."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id is in no fold (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def range_parts(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` staged by ranges of ``order``, with ``_part``, the place of each row's range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_last() for c in order])
    return stage(ranged.withColumn("_part", F.spark_partition_id()), name)


def sums_before(parts: DataFrame, **sums: Column) -> DataFrame:
    """By ``_part`` what all parts before it sum up to: one row for each range partition, so the window is small."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = parts.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    return per.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).cast("long").alias(k) for k in sums])


def by_group(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` joined with their group (``key``, its number of rows ``n``, and more).

    Groups of over a thousandth of all rows are fewer than a thousand, so that they are broadcast, and
    their rows don't move; the other groups are shuffled.
    """
    least = max(1000, rows.count() // 1000)
    hot = F.broadcast(groups.filter(F.col("n") > least).withColumn("_hot", F.lit(True)))
    near = rows.join(hot, key, "left")
    rest = near.filter(F.col("_hot").isNull()).select(*rows.columns).join(groups.filter(F.col("n") <= least), key)
    return near.filter("_hot").drop("_hot").unionByName(rest)
