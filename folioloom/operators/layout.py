"""Project-wide size statistics, votes and summaries over page tables.

Statistics of all pages are scalar subqueries: they are computed once and reach every row as a value,
so that no window puts a whole project into one task. Medians interpolate; they are found when the
plan is made (``exact_medians``) and enter it as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _valid(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def deviation(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with mean, sigma (sample) and n (all keys) of ``value`` over all rows or over each group; NaN is no value."""
    v = F.when(_valid(F.col(value)), F.col(value))
    stats = F.struct(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(float("nan"))).alias("sigma"), F.count(F.lit(1)).alias("n"))
    if by:
        return df.join(df.groupBy(*by).agg(stats.alias("stats")), by)
    return df.withColumn("stats", df.agg(stats).scalar())


def is_deviant(value: Column, stats: Column, factor: float = 1.0, percent: float = 0.0, default: bool = False) -> Column:
    """Whether a value lies further from the mean than ``factor`` sigmas and ``percent`` of the mean; never with fewer than 3 keys."""
    limit = F.greatest(factor * stats["sigma"], percent / 100 * stats["mean"])
    return F.when(stats["n"] < 3, F.lit(False)).when(~_valid(value), F.lit(default)).otherwise(F.abs(value - stats["mean"]) > limit)


def deviation_value(value: Column, stats: Column) -> Column:
    """Distance from the mean; 0 with fewer than 2 keys, -1 for a missing value or NaN."""
    return F.when(value.isNull(), -1.0).when(stats["n"] < 2, 0.0).when(F.isnan(value), -1.0).otherwise(F.abs(value - stats["mean"]))


def aggregate_size(df: DataFrame) -> DataFrame:
    """The largest width and height over aligned pages (w, h, aligned); 0 when there is none."""
    return df.agg(*[F.coalesce(F.max(F.when(F.col("aligned"), F.col(c)).otherwise(0.0)), F.lit(0.0)).alias(f"agg_{c}") for c in ("w", "h")])


def aggregate_what_if(df: DataFrame, new_w: Column, new_h: Column, new_aligned: Column | None = None) -> DataFrame:
    """Of each page (page_id, w, h, aligned): the aggregate size if the page had another size.

    Only the page that is the present maximum changes it, to the larger of its new size and the second
    largest; any other page leaves it as it is, however large its new size. Of equal maxima the
    smallest id counts as the one. A page that would not be aligned leaves the plain aggregate.
    """
    out = df
    for c, new in (("w", new_w), ("h", new_h)):
        size = F.when(F.col("aligned"), F.col(c)).otherwise(0.0)
        top = df.agg(F.slice(F.sort_array(F.array(F.max(F.struct(size.alias("v"), (-F.col("page_id")).alias("k")))), False), 1, 1)[0]).scalar()
        second = df.withColumn("_top", top).filter(F.col("page_id") != -F.col("_top")["k"]).agg(F.coalesce(F.max(size), F.lit(0.0))).scalar()
        out = out.withColumns({f"_top_{c}": top, f"_second_{c}": second})
        own = (F.col("page_id") == -F.col(f"_top_{c}")["k"]) & (F.lit(True) if new_aligned is None else new_aligned)
        out = out.withColumn(f"agg_{c}", F.when(own, F.greatest(new, F.col(f"_second_{c}"))).otherwise(F.col(f"_top_{c}")["v"])).drop(f"_top_{c}", f"_second_{c}")
    return out


def excessive_soft_margins(df: DataFrame, threshold: float) -> DataFrame:
    """Aligned pages that fall short of the aggregate width or height by ``threshold`` of it or more: ratio, largest first by ``pos``."""
    agg = aggregate_size(df).select(F.struct("agg_w", "agg_h")).scalar()
    short = lambda c: F.when(F.col("_a")[f"agg_{c}"] > 0, (F.col("_a")[f"agg_{c}"] - F.col(c)) / F.col("_a")[f"agg_{c}"]).otherwise(0.0)
    rows = df.filter("aligned").withColumn("_a", agg).withColumn("ratio", F.greatest(short("w"), short("h")))
    return rows.filter(F.col("ratio") >= threshold).drop("_a")


#: Distances from the middle at which a sketch is asked for bounds of the median, and the sketch's accuracy.
NEAR, ACCURACY = (2e-4, 2e-2, 0.5), 20_000


def exact_medians(df: DataFrame, columns: list[str], **more: Column) -> dict[str, float | None]:
    """Exact medians of numeric columns (nulls don't count; None without values), the mean of the middle two where they differ.

    ``more`` are aggregates to take in the same pass, returned by their names.

    A mergeable sketch of bounded size gives bounds around the middle; only values between them are
    counted one by one, by a shuffle on the value, and ranked in a window that can spill. The sketch
    decides what is counted, never the result: where its bounds don't hold the middle, all values are ranked.
    """
    shares = [0.5 + d for near in NEAR for d in (-near, near)]
    row = df.agg(*[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("q", lambda v: F.percentile_approx(v.cast("double"), shares, ACCURACY)))], *[a.alias(k) for k, a in more.items()]).first()
    size = {i: row[f"n{i}"] for i in range(len(columns))}
    out: dict[str, float | None] = {c: None for c in columns}
    for all_values in (False, True):
        todo = [i for i, c in enumerate(columns) if size[i] and out[c] is None]
        if not todo:
            break
        kept = []
        for i in todo:
            at = next((k for k, near in enumerate(NEAR) if near * size[i] > 2 + 2 * size[i] / ACCURACY), len(NEAR) - 1)
            low, high = (float("-inf"), float("nan")) if all_values else row[f"q{i}"][2 * at : 2 * at + 2]
            v = F.col(columns[i]).cast("double")
            # what lies under the bounds is one entry, without a value
            kept.append(F.when(v <= high, F.struct(F.lit(i).alias("i"), F.when(v >= low, v).alias("v"))))
        each = df.select(F.explode(F.array(*kept)).alias("_s")).filter("_s is not null").select("_s.*").groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
        upto = each.withColumn("upto", F.sum("c").over(W.partitionBy("i").orderBy(F.col("v").asc_nulls_first())))
        n = F.element_at(F.create_map(*[F.lit(x) for i in todo for x in (i, size[i])]), F.col("i"))
        middle = upto.withColumn("n", n).filter("v is not null and upto > (n - 1) div 2 and upto - c <= n div 2").collect()  # two rows a column at most
        for i in todo:
            pick = [next((r.v for r in middle if r.i == i and r.upto - r.c <= k < r.upto), None) for k in ((size[i] - 1) // 2, size[i] // 2)]
            if None not in pick:
                out[columns[i]] = 0.5 * pick[0] + 0.5 * pick[1]
    return out | {k: row[k] for k in more}


def _medians(df: DataFrame) -> Column:
    """Medians, maxima and number of rows as one value."""
    got = exact_medians(df, ["w", "h"], xw=F.max("w"), xh=F.max("h"), n=F.count(F.lit(1)))
    return F.struct(*[F.lit(got[k]).cast("long" if name == "n" else "double").alias(name) for k, name in (("w", "mw"), ("h", "mh"), ("xw", "xw"), ("xh", "xh"), ("n", "n"))])


def outliers(df: DataFrame, threshold: float) -> DataFrame:
    """Aligned pages with an area off the product of the medians by ``threshold`` or more, either way.

    Columns ratio, severity (either way at least 1), sets_w and sets_h (whether the page makes the aggregate).
    Nothing with fewer than two aligned pages that have a size.
    """
    some = df.filter("aligned and w > 0 and h > 0")
    rows = some.withColumn("_m", _medians(some)).filter(F.col("_m")["n"] >= 2)
    ratio = F.col("w") * F.col("h") / (F.col("_m")["mw"] * F.col("_m")["mh"])
    out = rows.withColumn("ratio", ratio).withColumns({
        "severity": F.greatest(F.col("ratio"), 1 / F.col("ratio")),
        "sets_w": F.abs(F.col("w") - F.col("_m")["xw"]) < 0.01, "sets_h": F.abs(F.col("h") - F.col("_m")["xh"]) < 0.01,
    })
    return out.filter(F.when(F.col("ratio") > 1, F.col("ratio") >= threshold).otherwise(F.col("ratio") <= 1 / threshold)).drop("_m")


def unsplit_spreads(df: DataFrame) -> DataFrame:
    """Pages about as wide as the widest, when that is about twice the median width. Heights don't matter."""
    some = df.filter("aligned and w > 0")
    rows = some.withColumn("_m", _medians(some)).withColumns({"spread": F.col("_m")["xw"] / F.col("_m")["mw"], "of_widest": F.col("w") / F.col("_m")["xw"]})
    return rows.filter("spread > 1.8 and spread < 2.2 and of_widest > 0.9 and of_widest < 1.1").drop("_m")


def majority_vote(images: DataFrame, by: list[str]) -> DataFrame:
    """Votes (``by``, image_id, split boolean or null) to one verdict: split, single, or none on a tie. An image votes once; null is single."""
    votes = images.groupBy(*by, "image_id").agg(F.max(F.coalesce(F.col("split"), F.lit(False))).alias("split"))
    counts = votes.groupBy(*by).agg(F.count_if("split").alias("n_split"), F.count_if(~F.col("split")).alias("n_single"))
    verdict = F.when(F.col("n_split") > F.col("n_single"), "split").when(F.col("n_split") < F.col("n_single"), "single").otherwise("none")
    return counts.withColumn("verdict", verdict).withColumn("n_flipped", F.when(F.col("verdict") == "none", 0).otherwise(F.least("n_split", "n_single")))


def coverage(df: DataFrame, low: float = 0.5) -> DataFrame:
    """Share of the page (page_w, page_h) that content (w, h) covers; 1 for a page without area. Rows without a rect, or disabled, are out."""
    rows = df.filter("w is not null and h is not null and page_w is not null and page_h is not null and coalesce(mode, '') <> 'disabled'")
    area = F.col("page_w") * F.col("page_h")
    return rows.withColumn("coverage", F.when(area > 0, F.col("w") * F.col("h") / area).otherwise(1.0)).withColumn("is_low", F.col("coverage") < low)


def width_deviation(df: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Of each page box the deviation of its width from the median in percent, and whether it is over the threshold."""
    rows = df.withColumn("_m", F.lit(exact_medians(df, ["w"])["w"]).cast("double"))
    return rows.withColumn("deviation", F.when(F.col("_m") > 0, F.abs(F.col("w") - F.col("_m")) / F.col("_m") * 100).otherwise(0.0)).withColumn("is_off", F.col("deviation") > threshold).drop("_m")


def margins_mm(page: str, content: str) -> dict[str, Column]:
    """Margins in mm between rects (structs x, y, w, h) and the content's size (mm_w, mm_h): the page's slack split in proportion, 0 under a pixel."""
    out = {}
    for near, far, at, size, mm in (("left", "right", "x", "w", "mm_w"), ("top", "bottom", "y", "h", "mm_h")):
        before = F.col(content)[at] - F.col(page)[at]
        after = F.col(page)[at] + F.col(page)[size] - F.col(content)[at] - F.col(content)[size]
        slack = before + after
        mm_slack = F.col(page)[size] * F.col(mm) / F.col(content)[size] - F.col(mm)
        out[near] = F.when(slack < 1, 0.0).otherwise(before * mm_slack / slack)
        out[far] = F.when(slack < 1, 0.0).otherwise(after * mm_slack / slack)
    return out


def soft_margins(surplus: Column, centre: Column, aggregate: Column, hard: Column, align: Column, names: tuple[str, str]) -> tuple[Column, Column]:
    """Soft margins before and after along one axis: the surplus of the aggregate over the hard size, dealt by alignment.

    ``centre`` is where the content's middle lies in the page, from 0 to 1, or null. ``align`` is auto,
    one of ``names``, center or original; null, or no surplus, gives 0.
    """
    near = F.when(centre.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(centre * aggregate - hard / 2, surplus)))
    far = surplus - near
    auto = F.when(3 * near < far, names[0]).when(3 * far < near, names[1]).otherwise("center")
    real = F.when(align == "auto", auto).otherwise(align)
    before = F.when(real == names[0], 0.0).when(real == names[1], surplus).when(real == "center", 0.5 * surplus).otherwise(near)
    none = align.isNull() | (surplus <= 0)
    return F.when(none, 0.0).otherwise(before), F.when(none, 0.0).otherwise(surplus - before)
