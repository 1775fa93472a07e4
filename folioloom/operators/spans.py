"""Content spans of one-dimensional profiles, and the page layouts that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_spans(profile: DataFrame, by: list[str], min_content: int, min_whitespace: int) -> DataFrame:
    """Blocks [b, e) of non-zero bins (i, n): gaps shorter than ``min_whitespace`` don't break a block; short blocks go."""
    w = W.partitionBy(*by).orderBy("i")
    full = profile.filter("n > 0").withColumn("_new", F.coalesce((F.col("i") - F.lag("i").over(w) - 1 >= min_whitespace), F.lit(True)).cast("int"))
    blocks = full.withColumn("_k", F.sum("_new").over(w)).groupBy(*by, "_k").agg(F.min("i").alias("b"), (F.max("i") + 1).alias("e"))
    return blocks.filter(F.col("e") - F.col("b") >= min_content).drop("_k")


def drop_edge_spans(spans: DataFrame, by: list[str], share: int = 15) -> DataFrame:
    """Spans without thin ones at either edge: the narrower end goes as long as it fits the budget of total width div ``share``.

    A fold over the sorted spans of one profile; a page has a few dozen.
    """
    item = "struct<b:int,e:int>"
    listed = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), F.col("e").cast("int").alias("e")))).alias("_s"))
    width = lambda s: s["e"] - s["b"]
    total = F.aggregate("_s", F.lit(0), lambda a, s: a + width(s))
    state = F.struct(F.col("_s").cast(f"array<{item}>").alias("s"), F.expr(f"cast(aggregate(_s, 0, (a, s) -> a + (s.e - s.b)) div {share} as int)").alias("left"))

    def step(a, _):
        first, last = a["s"][0], F.element_at(a["s"], -1)
        left_end = width(first) <= width(last)
        cost = F.when(left_end, width(first)).otherwise(width(last))
        kept = F.when(left_end, F.slice(a["s"], 2, F.size(a["s"]))).otherwise(F.slice(a["s"], 1, F.size(a["s"]) - 1))
        goes = (F.size(a["s"]) > 1) & (cost <= a["left"])
        return F.struct(F.when(goes, kept).otherwise(a["s"]).alias("s"), F.when(goes, a["left"] - cost).otherwise(F.lit(-1)).alias("left"))

    done = listed.withColumn("_t", total).withColumn("_r", F.aggregate(F.sequence(F.lit(1), F.size("_s")), state, step))
    return done.select(*by, F.explode("_r.s").alias("_x")).select(*by, "_x.b", "_x.e")


def cut_position(spans: DataFrame, by: list[str], width: int, two_pages: bool) -> DataFrame:
    """Where to cut an image of ``width``: for two pages in the widest gap among those that divide the content nearly best.

    A gap's ratio is that of the content extents on its two sides. If no gap divides better than one to
    four, and for a single span, the single-span rule holds: the page's centre if the span keeps over 15
    from it, else 15 beside the span on its emptier side. Without spans the centre is cut.
    """
    w = W.partitionBy(*by).orderBy("b")
    listed = spans.withColumns({"_next": F.lead("b").over(w), "_first": F.min("b").over(W.partitionBy(*by)), "_last": F.max("e").over(W.partitionBy(*by))})
    left, right = F.col("e") - F.col("_first"), F.col("_last") - F.col("_next")
    gaps = listed.filter(F.col("_next").isNotNull()).withColumns({"ratio": F.least(left, right) / F.greatest(left, right), "gap": F.col("_next") - F.col("e"), "at": (F.col("e") + F.col("_next")) / 2.0})
    good = gaps.withColumn("_best", F.max("ratio").over(W.partitionBy(*by))).filter((F.col("_best") >= 0.25) & (F.col("ratio") >= 0.9 * F.col("_best")))
    widest = good.groupBy(*by).agg(F.max_by("at", F.struct("gap", -F.col("at"))).alias("gap_cut"))
    ends = spans.groupBy(*by).agg(F.min("b").alias("b"), F.max("e").alias("e"))
    centre = width / 2.0
    away = F.greatest(F.col("b") - centre, centre - F.col("e"))
    one = F.when(away > 15, F.lit(centre)).when(F.col("b") > width - F.col("e"), F.col("b") - 15.0).otherwise(F.col("e") + 15.0)
    out = ends.join(widest, by, "left")
    return out.select(*by, (F.coalesce("gap_cut", one) if two_pages else one).alias("cut"))


def longest_run(flags: DataFrame, by: list[str]) -> DataFrame:
    """The longest run of true flags (by, i, flag), the first of equal ones."""
    run = F.col("i") - F.row_number().over(W.partitionBy(*by).orderBy("i"))
    runs = flags.filter("flag").withColumn("_r", run).groupBy(*by, "_r").agg(F.min("i").alias("b"), (F.max("i") + 1).alias("e"))
    best = runs.groupBy(*by).agg(F.max_by(F.struct("b", "e"), F.struct(F.col("e") - F.col("b"), -F.col("b"))).alias("_m"))
    return best.select(*by, "_m.b", "_m.e")


def detect_edge(lines: DataFrame, by: list[str], light_run: int = 10) -> DataFrame:
    """Last black line before the first run of over ``light_run`` lines that aren't (by, i, black, pixels); -1 when there is none.

    A line is black when 95 % or more of its pixels are.
    """
    w = W.partitionBy(*by).orderBy("i")
    marked = lines.withColumn("_dark", (F.col("black") * 100 >= F.col("pixels") * 95).cast("int"))
    seen = marked.withColumn("_last", F.coalesce(F.max(F.when(F.col("_dark") == 1, F.col("i"))).over(w), F.lit(-1)))
    stop = seen.withColumn("_run", F.col("i") - F.col("_last")).withColumn("_over", F.max("_run").over(w) > light_run)
    return stop.filter(~F.col("_over") | (F.col("_run") == light_run + 1)).groupBy(*by).agg(F.max("_last").alias("edge"))


def arc_length(points: DataFrame, by: list[str]) -> DataFrame:
    """Length along a polyline (by, x, y) up to each point, in order of x."""
    w = W.partitionBy(*by).orderBy("x")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    step = points.withColumn("_d", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return step.withColumn("length", F.sum("_d").over(w)).drop("_d")


def interpolate(mapped: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Of each wanted x (by, x) the length between its neighbours in ``mapped`` (by, x, length); constant outside.

    Both sides go into one window by x, so there is no range join.
    """
    both = mapped.select(*by, F.col("x").cast("double").alias("x"), F.col("length"), F.lit(0).alias("_want")).unionByName(wanted.select(*by, F.col("x").cast("double").alias("x"), F.lit(None).cast("double").alias("length"), F.lit(1).alias("_want")))
    w = W.partitionBy(*by).orderBy("x", "_want")
    known = F.when(F.col("_want") == 0, F.struct("x", "length"))
    near = both.withColumn("_a", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_b", F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    a, b = F.col("_a"), F.col("_b")
    between = a["length"] + (F.col("x") - a["x"]) * (b["length"] - a["length"]) / (b["x"] - a["x"])
    value = F.when(a.isNull(), b["length"]).when(b.isNull() | (a["x"] == F.col("x")), a["length"]).otherwise(between)
    return near.filter("_want = 1").select(*by, "x", value.alias("length"))


def polynomial_moments(points: DataFrame, by: list[str], degree: int) -> DataFrame:
    """Sums for a least-squares polynomial of (by, x, y): powers of x, and of x times y. Solved in one small step by key."""
    return points.groupBy(*by).agg(
        F.array(*[F.sum(F.pow("x", F.lit(float(i)))) for i in range(2 * degree + 1)]).alias("xs"), F.array(*[F.sum(F.pow("x", F.lit(float(i))) * F.col("y")) for i in range(degree + 1)]).alias("xy"))


def line_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares line of each group: intercept and slope; a slope of 0 for points above each other."""
    m = polynomial_moments(points, by, 1)
    n, sx, sxx, sy, sxy = F.col("xs")[0], F.col("xs")[1], F.col("xs")[2], F.col("xy")[0], F.col("xy")[1]
    det = n * sxx - sx * sx
    slope = F.when(det == 0, 0.0).otherwise((n * sxy - sx * sy) / F.when(det == 0, 1.0).otherwise(det))
    return m.select(*by, ((sy - slope * sx) / n).alias("intercept"), slope.alias("slope"))
