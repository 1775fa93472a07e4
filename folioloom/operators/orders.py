"""Page orders as lists of sort columns. Every order ends in a unique key, so that it is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT_TYPES = ("auto", "single_uncut", "page_plus_offcut", "two_pages")
#: An automatic layout comes after all others.
AUTO_RANK = 100
SUBS = ("single", "left", "right")


def name_tokens(name: Column) -> Column:
    """A name as tokens that compare like its natural order: (0, number) for digits, (1, 0) for any other character."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.when(p.rlike(r"^\d"), p.try_cast("decimal(38,0)")).otherwise(0).alias("number")))


def natural_order(path: str) -> list[Column]:
    """Directory, then digits before other characters and runs of digits as numbers, then the plain name."""
    name = F.substring_index(path, "/", -1)
    return [F.expr(f"substring({path}, 1, length({path}) - length(substring_index({path}, '/', -1)))"), name_tokens(name), name]


def by_page_id() -> list[Column]:
    rank = F.when(F.col("sub") == "single", 0).when(F.col("sub") == "left", 1).otherwise(2)
    return [F.col("path"), F.col("page"), rank]


def by_image_id() -> list[Column]:
    return [F.col("path"), F.col("page")]


def by_size(size: str, key: str) -> list[Column]:
    """Width or height ascending, pages without one last."""
    return [F.col(size).asc_nulls_last(), F.col(key)]


def by_deviation(deviation: str, incomplete: str, key: str) -> list[Column]:
    """Incomplete pages first, then the largest deviation."""
    return [F.col(incomplete).desc(), F.col(deviation).desc(), F.col(key)]


def by_completeness(incomplete: str, key: str) -> list[Column]:
    return [F.col(incomplete).asc(), F.col(key)]


def by_split_type(layout: str, key: str) -> list[Column]:
    rank = F.when(F.col(layout) == "auto", AUTO_RANK)
    for i, name in enumerate(SPLIT_TYPES):
        rank = rank.when(F.col(layout) == name, i)
    return [rank.asc(), F.col(key)]


def reversed_order(df: DataFrame, order: list[Column], by: list[str], pos: str = "pos") -> DataFrame:
    """Positions in the opposite of an order: what was last, missing values too, comes first."""
    forward = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(pos, F.count(F.lit(1)).over(W.partitionBy(*by)) - forward)


def ranked(df: DataFrame, order: list[Column], by: list[str], pos: str = "pos") -> DataFrame:
    return df.withColumn(pos, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def top_k(df: DataFrame, order: list[Column], by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only k a group on each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
