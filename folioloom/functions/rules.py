"""Classifiers of page evidence as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("mid", "dark", "light", "coverage", "largest")
#: Names of the reasons, and the limits of caption text.
REASONS = ("global_chroma", "document_prior_absent", "widespread_continuous_tone", "localized_continuous_tone_with_document", "isolated_tone_below_region_minimum", "document_without_continuous_tone")
CAPTION = {"band": 0.18, "regions": 4, "area": 0.025, "inner": 0.020}


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def _parts(e: Column) -> dict[str, Column]:
    mid, dark, light, cover, largest = (e[k].cast("float") for k in FIELDS)
    prior = (mid < _f(0.45)) & (((dark > _f(0.10)) & (light > _f(0.30))) | (light > _f(0.70)))
    wide = (mid >= _f(0.10)) | (cover >= _f(0.70)) | (largest >= _f(0.70)) | (e["tiles"] >= 45)
    mixed = (e["region_tiles"] >= 2) & ((dark >= _f(0.08)) | (e["region_tiles"] >= 3)) & (largest >= _f(0.06))
    return {"prior": prior, "wide": wide, "mixed": mixed}


def color_class(e: Column) -> Column:
    """Evidence (is_gray, mid, dark, light, coverage, largest, tiles, region_tiles) to color, gray, mixed or bw; shares compare as floats."""
    p = _parts(e)
    return F.when(~e["is_gray"], "color").when(~p["prior"], "gray").when(p["wide"], "gray").when(p["mixed"], "mixed").otherwise("bw")


def color_reason(e: Column) -> Column:
    p = _parts(e)
    plain = F.when(e["tiles"] > 0, REASONS[4]).otherwise(REASONS[5])
    return F.when(~e["is_gray"], REASONS[0]).when(~p["prior"], REASONS[1]).when(p["wide"], REASONS[2]).when(p["mixed"], REASONS[3]).otherwise(plain)


def caption_evidence(regions: DataFrame, by: list[str]) -> DataFrame:
    """Text regions (by, x, y, w, h as shares of the page) of a page: how many, their area, and whether they are just captions.

    They are, when they are few and small, one touches the outer band, and little lies further inside.
    """
    middle, area = F.col("y") + F.col("h") / 2, F.greatest(F.lit(0.0), F.col("w")) * F.greatest(F.lit(0.0), F.col("h"))
    outer = (middle <= CAPTION["band"]) | (middle >= 1 - CAPTION["band"])
    sums = regions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"), F.count_if(outer).alias("n_outer"), F.coalesce(F.sum(F.when(~outer, area)), F.lit(0.0)).alias("inner_area"))
    small = (F.col("n") <= CAPTION["regions"]) & (F.col("area") <= CAPTION["area"]) & (F.col("inner_area") <= CAPTION["inner"])
    return sums.withColumn("is_caption", small & (F.col("n_outer") > 0))


def has_cast(r: Column, g: Column, b: Column, threshold: int = 5) -> Column:
    """Whether a channel is off the whole-number mean of the three by ``threshold`` or more."""
    mean = F.floor((r + g + b) / 3)
    return F.greatest(F.abs(r - mean), F.abs(g - mean), F.abs(b - mean)) >= threshold


def balance(value: Column, paper: Column) -> Column:
    """A channel's value with the gain that turns the paper to 245, between 0.2 and 6."""
    gain = F.greatest(F.lit(0.2), F.least(F.lit(6.0), 245.0 / paper))
    return F.least(F.lit(255), F.floor(value * gain)).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 11 + g * 16 + b * 5) / 32).cast("int")


def tone_table(exposure: float = 0, contrast: float = 0, highlights: float = 0, shadows: float = 0, whites: float = 0, blacks: float = 0) -> list[int]:
    """256 entries of a tone curve: exposure in stops, the rest from -100 to 100; 0 changes nothing, and values are cut, not rounded."""
    def ramp(lo: float, hi: float) -> np.ndarray:
        t = np.clip((v - lo) / (hi - lo), 0, 1)
        return t * t * (3 - 2 * t)

    v = np.arange(256) / 255.0
    v = v * 2.0**exposure
    if contrast:
        v = 0.5 + (v - 0.5) * 2.0 ** (contrast / 100 * 1.3)
    v = v - highlights / 100 * 0.4 * ramp(0.25, 1)
    v = v + shadows / 100 * 0.4 * (1 - ramp(0, 0.75))
    white, black = whites / 400, blacks / 400
    v = v + white * ramp(0.5, 1) * ((1 - v) if white > 0 else v)
    v = black + v * (1 - black) if black > 0 else np.maximum(0, v + black) / (1 + black)
    return np.clip(v * 255, 0, 255).astype(int).tolist()


def apply_table(value: Column, table: list[int]) -> Column:
    """A value through a 256-entry table; the table is a literal, so there is no join."""
    return F.element_at(F.array(*map(F.lit, table)), value + 1)


#: Weights of red and blue in the brightness; green has the rest.
BRIGHTNESS = {"yuv": (0.299, 0.114), "gray": (11 / 32, 5 / 32)}


def _level(value: Column) -> Column:
    """A channel cut towards 0 and to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), value.cast("int")))


def with_brightness(r: Column, g: Column, b: Column, brightness: Column, kind: str = "yuv") -> Column:
    """The colour (struct r, g, b) that has another brightness and the same chroma, rounded."""
    wr, wb = BRIGHTNESS[kind]
    wg = 1 - wr - wb
    shift = brightness - (wr * r + wg * g + wb * b)
    red, blue = r + shift, b + shift
    green = (brightness - red * wr - blue * wb) / wg
    return F.struct(_level(red + 0.5).alias("r"), _level(green + 0.5).alias("g"), _level(blue + 0.5).alias("b"))


def blend(start: Column, end: Column, share: Column) -> Column:
    """A channel on the way from one level to another; the share is cut to 0..1. Channels have 16 bits between, of which 8 are kept."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.shiftright(F.floor((start + (end - start) * t) / 255 * 65535 + 0.5).cast("int"), 8)


def mixed_level(level: Column, weight: Column) -> Column:
    """Aggregate: the mean level by whole weights, rounded half up; null where all weights are 0."""
    total = F.sum(weight)
    return F.when(total > 0, F.floor((F.sum(level * weight) + F.floor(total / 2)) / total)).cast("int")
