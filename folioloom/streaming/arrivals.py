"""Pages that arrive over time: running counts, project statistics, and new images in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.probes import image_metadata

FILE = "path string, modificationTime timestamp, length long, content binary"


def windowed_counts(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and key; what comes later than ``late`` is dropped, and windows are final after that."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
    )


def running_moments(pages: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number, sum and sum of squares of a value that grow as pages arrive: mean and sigma follow from them at any time."""
    v = F.when(~F.isnan(value), F.col(value))
    return pages.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("n_values"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))


def deviation_of(moments: DataFrame) -> DataFrame:
    """Mean and sample sigma of running moments."""
    n = F.col("n_values")
    mean = F.col("s1") / n
    var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("s2") - n * mean * mean) / (n - 1)))
    return moments.withColumns({"mean": mean, "sigma": F.sqrt(var)})


def once_each(pages: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each page once, however often it is announced within ``late``."""
    return pages.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def new_images(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """Metadata of image files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return image_metadata(files)
