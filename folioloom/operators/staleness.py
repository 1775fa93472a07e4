"""Joins of pages with stage parameters, staleness predicates, and merges of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stored results of an older automatic detector are computed anew.
DETECTOR_VERSION = 3
OCR_KEY = ("schema", "w", "h", "language", "accurate", "correction", "out_size", "out_mtime_ms")


def with_params(pages: DataFrame, params: DataFrame, key: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Pages with their parameters, or the defaults where there are none."""
    out = pages.join(params, key, "left")
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    return out


def propagate(pages: DataFrame, collected: DataFrame, key: list[str], column: str) -> DataFrame:
    """Pages with what a stage collected for them; where it collected nothing the old value is invalid."""
    return pages.drop(column).join(collected.select(*key, column), key, "left").withColumn("is_valid", F.col(column).isNotNull())


def force_layout(pages: DataFrame, images: DataFrame, layout: str) -> DataFrame:
    """Pages with ``layout`` set where the image is among ``images``."""
    chosen = images.select("image_id").distinct().withColumn("_chosen", F.lit(True))
    return pages.join(chosen, "image_id", "left").withColumn("layout", F.when(F.col("_chosen"), layout).otherwise(F.col("layout"))).drop("_chosen")


def stale(stored: DataFrame, current: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Of each current row whether the stored one is missing or differs in any column; two nulls are equal."""
    old = stored.select(*key, F.struct(*compare).alias("_old"))
    both = current.select(*key, F.struct(*compare).alias("_new")).join(old, key, "left")
    return both.select(*key, (~F.col("_old").eqNullSafe(F.col("_new"))).alias("is_stale"))


def fingerprint(columns: list[str]) -> Column:
    return F.xxhash64(F.struct(*columns))


def split_compatible(old: Column, new: Column, mode: Column, version: int = DETECTOR_VERSION) -> Column:
    """Whether a stored page split still holds: same rotation, size and layout type, and for automatic ones the same detector; no version means the present one."""
    same = (old["rotation"] == new["rotation"]) & (old["w"] == new["w"]) & (old["h"] == new["h"]) & (old["layout_type"] == new["layout_type"])
    return F.coalesce(same & ((mode != "auto") | (F.coalesce(old["detector_version"], F.lit(version)) == version)), F.lit(False))


def outlines_match(a: Column, b: Column, tolerance: float = 0.5) -> Column:
    """Whether polygons (arrays of x, y) have the same points within a tolerance."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, near), lambda x: F.coalesce(x, F.lit(False)))


def deskew_matches(old: Column, new: Column) -> Column:
    return (old["rotation"] == new["rotation"]) & outlines_match(old["outline"], new["outline"])


def deskew_zero(params: DataFrame, pages: DataFrame) -> DataFrame:
    """The deskew parameters (page_id, angle, mode, deps) with those of all given pages set by hand to angle 0, without dependencies; other pages keep theirs."""
    deps = params.schema["deps"].dataType
    rest = params.join(pages, "page_id", "left_anti").select("page_id", "angle", "mode", "deps")
    zero = pages.select("page_id").distinct().select("page_id", F.lit(0.0).alias("angle"), F.lit("manual").alias("mode"), F.lit(None).cast(deps).alias("deps"))
    return rest.unionByName(zero)


def content_needs(old: Column, new: Column, mode: Column) -> dict[str, Column]:
    """Which outputs of content selection must be computed again: automatic ones whose page rect or outline changed."""
    changed = ~old.eqNullSafe(new)
    return {"update_content": changed & (mode != "manual"), "update_size": changed}


def merge_records(primary: DataFrame, secondary: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """All records of either source; the primary wins, and the secondary fills what is empty there."""
    a = primary.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = secondary.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.join(b, key, "full_outer").select(*key, *[F.coalesce(F.nullif(F.col(f"_a_{c}"), F.lit("")), F.col(f"_b_{c}")).alias(c) for c in columns])


def overlaps(candidates: DataFrame, evidence: DataFrame, by: list[str], least: float, cell: int = 64) -> DataFrame:
    """Pairs of rects (``by``, id, x0, y0, x1, y1 half-open) that share ``least`` of the smaller one's area or more.

    Rects meet on the grid cells they touch, so that the join is an equi-join; a pair is taken in the
    first cell that both touch.
    """
    def cells(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*by, *[F.col(c).alias(f"{p}{c}") for c in ("id", "x0", "y0", "x1", "y1")])
        span = lambda lo, hi: F.sequence(F.floor(F.col(p + lo) / cell), F.floor((F.col(p + hi) - 1) / cell))
        wide = named.filter((F.col(p + "x1") > F.col(p + "x0")) & (F.col(p + "y1") > F.col(p + "y0")))
        return wide.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))

    both = cells(candidates, "a_").join(cells(evidence, "b_"), [*by, "_cx", "_cy"])
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    right, bottom = F.least("a_x1", "b_x1"), F.least("a_y1", "b_y1")
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    shared = F.greatest(F.lit(0), right - left) * F.greatest(F.lit(0), bottom - top)
    first = (F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy"))
    ratio = shared / F.least(area("a_"), area("b_"))
    return both.filter(first).withColumn("overlap", ratio).filter(F.col("overlap") >= least).select(*by, "a_id", "b_id", "overlap")


def add_components(labels: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Label maps (by, y, x, label > 0) united: the other's labels come after the largest, and lie on top."""
    most = labels.groupBy(*by).agg(F.max("label").alias("_most"))
    moved = other.join(most, by, "left").select(*by, "y", "x", (F.col("label") + F.coalesce("_most", F.lit(0))).alias("_new"))
    return labels.join(moved, [*by, "y", "x"], "full_outer").select(*by, "y", "x", F.coalesce("_new", "label").alias("label"))


def zones_equal(a: DataFrame, b: DataFrame, key: list[str], zone: str) -> DataFrame:
    """Whether two pages have the same zones in the same order (``key``, seq, zone)."""
    listed = lambda df, n: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", zone))), lambda s: s[zone]).alias(n))
    both = listed(a, "_a").join(listed(b, "_b"), key, "full_outer")
    return both.select(*key, F.col("_a").eqNullSafe(F.col("_b")).alias("is_equal"))
