"""Rasters as relations (img_id, y, x, v): histograms, thresholds, rolling windows, morphology, pixel sets.

Small rasters, tiles and thumbnails go this way, as whole expressions of the engine; full pages go
through the array kernels in ``functions.kernels``. Windows are partitioned by image and line, so
no task holds more than a line or column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IMG = "img_id"


def from_embeddings(embeddings: DataFrame, width: int = 8) -> DataFrame:
    """Float vectors as gray rasters, row by row: -1 to 1 becomes 0 to 255."""
    px = embeddings.select(F.col("vec_id").alias(IMG), F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 128).cast("int")))
    return px.select(IMG, F.expr(f"cast(i div {width} as int)").alias("y"), (F.col("i") % width).alias("x"), v.alias("v"))


def histogram(px: DataFrame) -> DataFrame:
    """256 bins of each image, empty ones too."""
    counts = px.groupBy(IMG, F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = px.select(IMG).distinct().select(IMG, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    return bins.join(counts, [IMG, "bin"], "left").select(IMG, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sliced_histogram(bits: DataFrame) -> DataFrame:
    """Black pixels (b = 1) of each row and each column."""
    rows = bits.groupBy(IMG, F.lit("row").alias("axis"), F.col("y").alias("i")).agg(F.sum("b").alias("n"))
    return rows.unionByName(bits.groupBy(IMG, F.lit("column").alias("axis"), F.col("x").alias("i")).agg(F.sum("b").alias("n")))


def otsu(px: DataFrame) -> DataFrame:
    """The threshold of largest between-class variance; midway between the first and last of equal ones, 0 for one gray."""
    counts = px.groupBy(IMG, F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto, all_ = W.partitionBy(IMG).orderBy("bin"), W.partitionBy(IMG)
    run = counts.select(IMG, "bin", F.sum("n").over(upto).alias("below"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("sum_below"), F.sum("n").over(all_).alias("total"), F.sum(F.col("n") * F.col("bin")).over(all_).alias("sum_all"), F.lead("bin").over(upto).alias("next_bin"))
    above, sum_above = F.col("total") - F.col("below"), F.col("sum_all") - F.col("sum_below")
    diff = F.col("sum_below").cast("double") / F.col("below") - sum_above.cast("double") / above
    between = run.filter(above > 0).withColumn("score", diff * diff * F.col("below") * above)
    # the score is the same in the empty bins up to the next one in use
    best = between.withColumn("_best", F.max("score").over(all_)).filter(F.col("score") == F.col("_best"))
    found = best.groupBy(IMG).agg(F.expr("cast((min(bin) + 1 + max(next_bin)) div 2 as int)").alias("threshold"))
    return counts.select(IMG).distinct().join(found, IMG, "left").select(IMG, F.coalesce("threshold", F.lit(0)).alias("threshold"))


def binarize(px: DataFrame, thresholds: DataFrame) -> DataFrame:
    return px.join(thresholds, IMG).select(IMG, "y", "x", (F.col("v") < F.col("threshold")).cast("int").alias("b"))


def bounding_box(bits: DataFrame) -> DataFrame:
    """Number and bounding box of black pixels; null box when there is none."""
    black = F.col("b") == 1
    return bits.groupBy(IMG).agg(F.count_if(black).alias("n"), *[f(F.when(black, F.col(c))).alias(f"{c}{k}") for c in ("x", "y") for f, k in ((F.min, 0), (F.max, 1))])


def integral(px: DataFrame) -> DataFrame:
    """Summed-area table: along rows, then down columns."""
    rows = px.withColumn("s", F.sum("v").over(W.partitionBy(IMG, "y").orderBy("x")))
    return rows.withColumn("s", F.sum("s").over(W.partitionBy(IMG, "x").orderBy("y"))).select(IMG, "y", "x", "s")


def box_sum(table: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    """Sum over the half-open rect of each image, from four corners of its summed-area table."""
    corner = lambda y, x: F.sum(F.when((F.col("y") == y - 1) & (F.col("x") == x - 1), F.col("s")).otherwise(0))
    return table.groupBy(IMG).agg((corner(y1, x1) - corner(y0, x1) - corner(y1, x0) + corner(y0, x0)).alias("s"))


def _frame(size: int) -> tuple[int, int]:
    return -(size // 2), size - size // 2 - 1


def rolling(px: DataFrame, aggregate, wh: int, ww: int, column: str = "v", out: str = "v") -> DataFrame:
    """A separable aggregate (min, max, sum) over windows of wh x ww around each pixel, clipped at the edges."""
    along = W.partitionBy(IMG, "y").orderBy("x").rowsBetween(*_frame(ww))
    down = W.partitionBy(IMG, "x").orderBy("y").rowsBetween(*_frame(wh))
    return px.withColumn(out, aggregate(column).over(along)).withColumn(out, aggregate(out).over(down))


def dilate(px: DataFrame, wh: int = 3, ww: int = 3, column: str = "v", dark: bool = True) -> DataFrame:
    """In gray images the dark grows (minimum); for bits, where 1 is black, pass dark=False (maximum)."""
    return rolling(px, F.min if dark else F.max, wh, ww, column, column)


def erode(px: DataFrame, wh: int = 3, ww: int = 3, column: str = "v", dark: bool = True) -> DataFrame:
    return rolling(px, F.max if dark else F.min, wh, ww, column, column)


def opened(px: DataFrame, wh: int = 3, ww: int = 3, column: str = "v", dark: bool = True) -> DataFrame:
    return dilate(erode(px, wh, ww, column, dark), wh, ww, column, dark)


def closed(px: DataFrame, wh: int = 3, ww: int = 3, column: str = "v", dark: bool = True) -> DataFrame:
    return erode(dilate(px, wh, ww, column, dark), wh, ww, column, dark)


def top_hats(bits: DataFrame, wh: int = 3, ww: int = 3) -> DataFrame:
    """White top hat (black lost by opening) and black top hat (black won by closing) of bits."""
    o = opened(bits.withColumn("o", F.col("b")), wh, ww, "o", dark=False)
    both = closed(o.withColumn("c", F.col("b")), wh, ww, "c", dark=False)
    return both.select(IMG, "y", "x", (F.col("b") - F.col("o")).alias("white_hat"), (F.col("c") - F.col("b")).alias("black_hat"))


def morph_gradient(px: DataFrame, wh: int = 3, ww: int = 3) -> DataFrame:
    """Gradient on the dark side (eroded minus source) and on the light side (source minus dilated)."""
    both = dilate(erode(px.withColumns({"e": F.col("v"), "d": F.col("v")}), wh, ww, "e"), wh, ww, "d")
    return both.select(IMG, "y", "x", (F.col("e") - F.col("v")).alias("dark_side"), (F.col("v") - F.col("d")).alias("light_side"))


def local_stats(px: DataFrame, wh: int, ww: int) -> DataFrame:
    """Mean ``m`` and population deviation ``s`` over clipped windows, from whole-number sums."""
    df = px.withColumns({"_v2": F.col("v").cast("long") * F.col("v"), "_one": F.lit(1)})
    for c, out in (("v", "_s1"), ("_v2", "_s2"), ("_one", "_n")):
        df = rolling(df, F.sum, wh, ww, c, out)
    m = F.col("_s1").cast("double") / F.col("_n")
    return df.withColumns({"m": m, "s": F.sqrt(F.abs(F.col("_s2").cast("double") / F.col("_n") - m * m))}).drop("_v2", "_one", "_s1", "_s2", "_n")


def _global(stats: DataFrame, *aggregates: Column) -> DataFrame:
    return stats.join(stats.groupBy(IMG).agg(*aggregates), IMG)


def local_threshold(px: DataFrame, method: str, wh: int = 5, ww: int = 5, k: float = 0.34, delta: float = 0.0, lower: int = 1, upper: int = 254) -> DataFrame:
    """Bits (img_id, y, x, b) by a local rule: sauvola, wolf, bradley, niblack, nick, singh, wan, fox, window."""
    st = local_stats(px, wh, ww)
    v, m, s = F.col("v").cast("double"), F.col("m"), F.col("s")
    if method == "sauvola":
        t = m * (1 + k * ((s + delta) / 128 - 1))
    elif method == "bradley":
        t = m * (1 - k) if k < 1 else F.lit(0.0)
    elif method == "niblack":
        t = m - k * (s - delta)
    elif method == "nick":
        t = m - k * F.sqrt(s * s + (50 - delta) * 0.01 * m * m)
    elif method == "singh":
        d = F.abs(v - m)
        f = d / (256 - d + 1e-6)
        t = m * (1 - 0.5 * k * (1 - (f + delta / 128)))
    elif method == "wan":
        st = rolling(st, F.max, wh, ww, "v", "_lm")
        t = (m + F.col("_lm")) / 2 * (1 - k * (1 - (s + delta) / 128))
    elif method == "wolf":
        st = _global(st, F.max("s").alias("_smax"), F.min("v").alias("_gmin"))
        t = m - k * (1 - (s / F.col("_smax") + delta / 128)) * (m - F.col("_gmin"))
        return st.select(IMG, "y", "x", ((v < lower) | ((v <= upper) & F.coalesce(v < t, F.lit(False)))).cast("int").alias("b"))
    elif method == "fox":
        st = _global(st.withColumn("_f", (v - m) / (256 - (v - m))), F.max(F.abs("_f")).alias("_fmax"), F.min("v").alias("_gmin"))
        base = m - F.col("_gmin")
        f = F.when(F.col("_fmax") > 0, F.col("_f") / F.col("_fmax")).otherwise(1.0)
        t = F.least(F.lit(255.0), F.greatest(F.lit(0.0), base * (1 - 0.5 * k * (1 - (f + delta / 128))) + F.col("_gmin")))
    elif method == "window":
        st = _global(st, F.avg("v").alias("_gm"), F.min("s").alias("_smin"), F.max("s").alias("_smax"))
        span = F.col("_smax") - F.col("_smin")
        md = (m + 1 - delta) / (F.col("_gm") + s + 1)
        kds = F.when(span == 0, 1.0).otherwise((s - F.col("_smin")) / span)
        t = m * (1 - k * md / (1 + (2 * F.col("_gm") + 1) / (s + 1) * kds))
    else:
        raise ValueError(f"no such rule: {method}")
    return st.select(IMG, "y", "x", (v < t).cast("int").alias("b"))


def sobel(px: DataFrame) -> DataFrame:
    """Horizontal and vertical 3 x 3 gradients; pixels beyond an edge repeat the edge."""
    row, col = W.partitionBy(IMG, "y").orderBy("x"), W.partitionBy(IMG, "x").orderBy("y")
    near = lambda c, n, w: F.coalesce((F.lag if n < 0 else F.lead)(c, 1).over(w), F.col(c))
    df = px.withColumns({"_dx": near("v", 1, row) - near("v", -1, row), "_sx": near("v", 1, row) + 2 * F.col("v") + near("v", -1, row)})
    gx = near("_dx", 1, col) + 2 * F.col("_dx") + near("_dx", -1, col)
    return df.select(IMG, "y", "x", gx.alias("gx"), (near("_sx", 1, col) - near("_sx", -1, col)).alias("gy"))


def wiener(px: DataFrame, wh: int = 3, ww: int = 3, sigma: float = 5.0) -> DataFrame:
    """Adaptive denoising: towards the local mean where the local variance is that of the noise."""
    st, var = local_stats(px, wh, ww), F.col("s") * F.col("s")
    out = F.when(var > 1e-6, F.col("m") + (F.col("v") - F.col("m")) * F.greatest(F.lit(0.0), var - sigma * sigma) / var).otherwise(F.col("m"))
    return st.select(IMG, "y", "x", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), out))).cast("int").alias("v"))


def reduce_bits(bits: DataFrame, threshold: int) -> DataFrame:
    """Half the size: a pixel is black when ``threshold`` of its four are; odd last lines go."""
    cells = bits.groupBy(IMG, F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.sum("b").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return cells.filter("_n = 4").select(IMG, "y", "x", (F.col("_s") >= threshold).cast("int").alias("b"))


def scale_down(px: DataFrame, factor: int) -> DataFrame:
    """Area average by a whole factor, rounded."""
    y, x = F.expr(f"cast(y div {factor} as int)"), F.expr(f"cast(x div {factor} as int)")
    return px.groupBy(IMG, y.alias("y"), x.alias("x")).agg(F.expr("cast((2 * sum(v) + count(1)) div (2 * count(1)) as int)").alias("v"))


def scale_up(px: DataFrame, times: int) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(times - 1))
    wide = px.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    return wide.select(IMG, (F.col("y") * times + F.col("_dy")).alias("y"), (F.col("x") * times + F.col("_dx")).alias("x"), "v")


def rotate(px: DataFrame, degrees: int, w: int, h: int) -> DataFrame:
    """Clockwise by a multiple of 90 degrees."""
    x, y = F.col("x"), F.col("y")
    ny, nx = {0: (y, x), 90: (x, h - 1 - y), 180: (h - 1 - y, w - 1 - x), 270: (w - 1 - x, y)}[degrees % 360]
    return px.select(IMG, ny.alias("y"), nx.alias("x"), "v")


def shear(px: DataFrame, slope: float, origin: float, size: int, horizontal: bool = True, background: int = 255) -> DataFrame:
    """Rows (or columns) shifted by a whole number of pixels that grows with their distance from the origin; what comes free is background."""
    along, across = ("x", "y") if horizontal else ("y", "x")
    moved = px.withColumn(along, F.col(along) + F.floor(slope * (F.col(across) + 0.5 - origin) + 0.5).cast("int"))
    back = px.select(IMG, "y", "x")
    return back.join(moved.filter(F.col(along).between(0, size - 1)), [IMG, "y", "x"], "left").select(IMG, "y", "x", F.coalesce("v", F.lit(background)).alias("v"))


def pixel_set(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Sets of black pixels (img_id, y, x): and, or, xor, subtract."""
    if op == "and":
        return a.intersect(b)
    if op == "or":
        return a.union(b).distinct()
    if op == "subtract":
        return a.exceptAll(b)
    if op == "xor":
        return a.exceptAll(b).union(b.exceptAll(a))
    raise ValueError(op)


#: Gray raster operations on values a and b from 0 to 255.
GRAY_OPS = {
    "invert": lambda a, b: 255 - a,
    "clipped_subtract": lambda a, b: F.greatest(F.lit(0), a - b),
    "unclipped_subtract": lambda a, b: F.pmod(a - b, F.lit(256)),
    "clipped_add": lambda a, b: F.least(F.lit(255), a + b),
    "unclipped_add": lambda a, b: F.pmod(a + b, F.lit(256)),
    "darkest": lambda a, b: F.least(a, b),
    "lightest": lambda a, b: F.greatest(a, b),
}


def gray_op(a: DataFrame, b: DataFrame, op) -> DataFrame:
    """Two rasters of the same images, pixel by pixel; ``op`` is a name of GRAY_OPS or a function of two columns."""
    f = GRAY_OPS.get(op, op) if isinstance(op, str) else op
    return a.join(b.select(IMG, "y", "x", F.col("v").alias("_b")), [IMG, "y", "x"]).select(IMG, "y", "x", f(F.col("v"), F.col("_b")).alias("v"))


def gray_op_arrays(a: Column, b: Column, op) -> Column:
    """The same on flat pixel arrays, without a join."""
    return F.zip_with(a, b, GRAY_OPS.get(op, op) if isinstance(op, str) else op)


#: Operations on bits: s of the source, d of the destination; black is 1.
BIT_OPS = {
    "src": lambda s, d: s,
    "dst": lambda s, d: d,
    "not_src": lambda s, d: 1 - s,
    "not_dst": lambda s, d: 1 - d,
    "and": lambda s, d: s.bitwiseAND(d),
    "or": lambda s, d: s.bitwiseOR(d),
    "xor": lambda s, d: s.bitwiseXOR(d),
    "subtract": lambda s, d: s.bitwiseAND(1 - d),
    "subtract_white": lambda s, d: s.bitwiseOR(1 - d),
}


def bit_op(src: DataFrame, dst: DataFrame, op) -> DataFrame:
    """Two bit rasters of the same images, pixel by pixel; ``op`` is a name of BIT_OPS or a function of two columns."""
    f = BIT_OPS.get(op, op) if isinstance(op, str) else op
    return src.join(dst.select(IMG, "y", "x", F.col("b").alias("_d")), [IMG, "y", "x"]).select(IMG, "y", "x", f(F.col("b"), F.col("_d")).alias("b"))


def stretch_range(px: DataFrame, black: float, white: float) -> DataFrame:
    """Levels stretched to 0..255 between two bounds, so that a share of the pixels is cut at either end.

    A share of 1 or more is the bound itself. Where the lower bound isn't under the upper one, the
    levels up to their mean turn 0 and the rest 255. An image's histogram has 256 rows at most.
    """
    n = px.groupBy(IMG, "v").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(IMG)
    total = F.sum("_n").over(w)
    up, down = F.sum("_n").over(w.orderBy("v")), F.sum("_n").over(w.orderBy(F.col("v").desc()))
    cut = lambda share: F.floor(share * F.col("_total") + 0.5)
    lo = F.lit(int(black + 0.5)) if black >= 1 else F.coalesce(F.min(F.when(F.col("_up") > cut(black), F.col("v"))), F.lit(256))
    hi = F.lit(int(white + 0.5)) if white >= 1 else F.coalesce(F.max(F.when(F.col("_down") > cut(white), F.col("v"))), F.lit(-1))
    bounds = n.withColumns({"_total": total, "_up": up, "_down": down}).groupBy(IMG).agg(F.max("_total").alias("_t"), lo.alias("_lo"), hi.alias("_hi"))
    level = F.greatest(F.col("_lo"), F.least(F.col("v"), F.col("_hi")))
    flat = F.when(F.col("v") <= F.expr("(_lo + _hi) div 2"), 0).otherwise(255)
    stretched = F.floor((255 * (level - F.col("_lo")) + F.floor((F.col("_hi") - F.col("_lo")) / 2)) / (F.col("_hi") - F.col("_lo")))
    return px.join(bounds, IMG).select(IMG, "y", "x", F.when(F.col("_lo") >= F.col("_hi"), flat).otherwise(stretched).cast("int").alias("v"))


def framed(images: DataFrame, w: int, h: int, inner: int = 255, frame: int = 0) -> DataFrame:
    """For each image a raster of one level with a frame of one pixel."""
    grid = images.select(IMG, F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).select(IMG, "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))
    edge = F.col("y").isin(0, h - 1) | F.col("x").isin(0, w - 1)
    return grid.withColumn("v", F.when(edge, frame).otherwise(inner))


def combine(base: DataFrame, over: DataFrame, mask: DataFrame) -> DataFrame:
    """``over`` where the mask is black, else ``base``."""
    top = over.join(mask.filter("b = 1"), [IMG, "y", "x"], "left_semi").select(IMG, "y", "x", F.col("v").alias("_o"))
    return base.join(top, [IMG, "y", "x"], "left").select(IMG, "y", "x", F.coalesce("_o", "v").alias("v"))


def apply_mask(px: DataFrame, mask: DataFrame, fill: int) -> DataFrame:
    """The raster where the mask is black, ``fill`` elsewhere."""
    inside = mask.filter("b = 1").select(IMG, "y", "x", F.lit(True).alias("_in"))
    return px.join(inside, [IMG, "y", "x"], "left").select(IMG, "y", "x", F.when(F.col("_in"), F.col("v")).otherwise(fill).alias("v"))


def draw_over(dst: DataFrame, src: DataFrame, dy: int, dx: int) -> DataFrame:
    """``src`` drawn at an offset; what falls outside is lost."""
    moved = src.select(IMG, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("v").alias("_s"))
    return dst.join(moved, [IMG, "y", "x"], "left").select(IMG, "y", "x", F.coalesce("_s", "v").alias("v"))


def hit_miss(bits: DataFrame, hits: list[tuple[int, int]], misses: list[tuple[int, int]]) -> DataFrame:
    """Pixels around which all hits (dy, dx) are black and all misses white; beyond the edge is white."""
    row = lambda dx: W.partitionBy(IMG, "y").orderBy("x")
    out = bits
    for i, (dy, dx) in enumerate([*hits, *misses]):
        out = out.withColumn("_a", F.coalesce(F.lead("b", dx).over(row(dx)), F.lit(0)) if dx else F.col("b"))
        down = W.partitionBy(IMG, "x").orderBy("y")
        out = out.withColumn(f"_n{i}", F.coalesce(F.lead("_a", dy).over(down), F.lit(0)) if dy else F.col("_a"))
    ok = F.lit(True)
    for i in range(len(hits) + len(misses)):
        ok = ok & (F.col(f"_n{i}") == (1 if i < len(hits) else 0))
    return out.select(IMG, "y", "x", ok.cast("int").alias("b"))


def plate_entropy(px: DataFrame, tiles: int = 6, size: int = 8) -> DataFrame:
    """Entropy over 64 bins, midtone share, and the share of tiles that look like a plate, with the verdict."""
    mid = F.col("v").between(20, 235).cast("int")

    def entropy(df: DataFrame, by: list[str]) -> DataFrame:
        per = df.groupBy(*by, F.expr("v div 4").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(mid).alias("mid"))
        total = per.groupBy(*by).agg(F.sum("n").alias("total"))
        p = F.col("n") / F.col("total")
        return per.join(total, by).groupBy(*by).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), (F.sum("mid") / F.max("total")).alias("mid"))

    tiled = px.withColumns({"ty": F.expr(f"y * {tiles} div {size}"), "tx": F.expr(f"x * {tiles} div {size}")})
    votes = entropy(tiled, [IMG, "ty", "tx"]).groupBy(IMG).agg((F.count_if((F.col("entropy") >= 4.6) & (F.col("mid") >= 0.35)) / float(tiles * tiles)).alias("tiles"))
    out = entropy(px, [IMG]).join(votes, IMG)
    plate = (F.col("entropy") >= 4.05) & (F.col("mid") >= 0.30) & (F.col("tiles") >= 0.08) & ((F.col("mid") < 0.93) | (F.col("tiles") >= 0.28) | (F.col("entropy") >= 4.35))
    return out.select(IMG, "entropy", "mid", "tiles", plate.alias("is_plate"))


def dominant_level(px: DataFrame, window: int = 10) -> DataFrame:
    """The bin where the densest ``window`` of bins (the first of equal ones) reaches half its mass."""
    h, w = histogram(px), W.partitionBy(IMG).orderBy("bin")
    dense = h.withColumn("mass", F.sum("n").over(w.rowsBetween(0, window - 1))).filter(F.col("bin") <= 256 - window)
    best = dense.groupBy(IMG).agg(F.max(F.struct(F.col("mass"), (-F.col("bin")).alias("b"))).alias("_m")).select(IMG, F.col("_m.mass").alias("mass"), (-F.col("_m.b")).alias("first"))
    inside = h.join(best, IMG).filter(F.col("bin").between(F.col("first"), F.col("first") + window - 1)).withColumn("_upto", F.sum("n").over(w))
    return inside.filter(F.expr("_upto >= mass div 2")).groupBy(IMG).agg(F.min("bin").alias("level"))


def hough(bits: DataFrame, angles: list[float], step: float = 1.0) -> DataFrame:
    """Votes of black pixels for lines (angle, distance); the angles are a fixed short list."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("theta"), F.lit(a).alias("_a")) for i, a in enumerate(angles)]))
    votes = bits.filter("b = 1").select(IMG, "y", "x", grid.alias("g")).select(IMG, "y", "x", "g.*")
    rho = F.floor(F.round((F.col("x") * F.cos("_a") + F.col("y") * F.sin("_a")) / step, 9) + 0.5).cast("int")
    return votes.groupBy(IMG, "theta", rho.alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def hough_peaks(votes: DataFrame, k: int) -> DataFrame:
    """The ``k`` lines of each image with most votes."""
    w = W.partitionBy(IMG).orderBy(F.col("votes").desc(), "theta", "rho")
    return votes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def skew_scores(bits: DataFrame, slopes: list[float], width: int) -> DataFrame:
    """By slope the sum of squared differences of neighbouring row counts after a vertical shear."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("_s")) for i, s in enumerate(slopes)]))
    moved = bits.select(IMG, "y", "x", "b", grid.alias("g")).select(IMG, "y", "x", "b", "g.*")
    rows = moved.groupBy(IMG, "step", (F.col("y") + F.floor(F.col("_s") * (F.col("x") - width / 2.0) + 0.5)).cast("int").alias("row")).agg(F.sum("b").alias("n"))
    w = W.partitionBy(IMG, "step").orderBy("row")
    d = F.col("n") - F.lag("n").over(w)
    return rows.withColumn("_d", d * d).groupBy(IMG, "step").agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("score"))


def best_skew(scores: DataFrame) -> DataFrame:
    return scores.groupBy(IMG).agg(F.min_by("step", F.struct(-F.col("score"), F.col("step"))).alias("step"), F.max("score").alias("score"), (F.max("score") / F.avg("score") - 1).alias("confidence"))
