"""Streams run to the end of the tables they read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import arrivals as A
from .registry import query, table


def _folder(spark) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        path = f"file://{tempfile.mkdtemp(prefix='folioloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("""
select user_id, event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sigma from events group by all
""")
def stream_page_moments(spark, sf_dir):
    """Project statistics from pages as they arrive, kept as running moments."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    folder, out = _folder(spark), {}

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/{number % 2}")
        out["at"] = number % 2

    moments = A.running_moments(stream, ["user_id", "event_type"], "value")
    run = moments.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    done = A.deviation_of(spark.read.schema(moments.schema).parquet(f"{folder}/{out['at']}") if out else spark.createDataFrame([], moments.schema))
    return done.select("user_id", "event_type", "n", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))
