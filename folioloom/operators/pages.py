"""The page relation: images, logical pages, positional selection, edits, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUB_RANK = {"single": 0, "left": 1, "right": 2}
FILTER_MODES = ("bw", "gray", "mixed", "color")
EXTENSIONS = (".tif", ".png", ".jpg")


def logical_pages(images: DataFrame, right_to_left: bool = False) -> DataFrame:
    """Images (image_id, n_pages 1 or 2, removed: null, left or right) to pages in layout direction, with ``sub`` and ``pos`` within the image."""
    halves = ["right", "left"] if right_to_left else ["left", "right"]
    two = F.filter(F.array(*map(F.lit, halves)), lambda s: F.col("removed").isNull() | (s != F.col("removed")))
    subs = F.when(F.col("n_pages") == 2, two).otherwise(F.array(F.lit("single")))
    return images.select("*", F.posexplode(subs).alias("sub_pos", "sub"))


def positions(pages: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Pages with ``pos`` from 0 in the given order, within each project of ``by``."""
    return pages.withColumn("pos", F.row_number().over(W.partitionBy(*(by or [])).orderBy(*order)) - 1)


def _base(pages: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """The positions of the base pages: one row for each project at most."""
    return pages.join(base, [*by, "page_id"], "left_semi").groupBy(*by).agg(F.min("pos").alias("base_pos"))


def page_numbers(wanted: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """The position of each wanted page, -1 if it isn't there."""
    return wanted.join(pages.select(*by, "page_id", "pos"), [*by, "page_id"], "left").withColumn("pos", F.coalesce("pos", F.lit(-1)))


def followers(pages: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """The base page of each project and all after it."""
    return pages.join(_base(pages, base, by), by).filter("pos >= base_pos").drop("base_pos")


def every_other(pages: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """Pages at an even distance from the base page; none where the base is missing."""
    return pages.join(_base(pages, base, by), by).filter("(pos - base_pos) % 2 = 0").drop("base_pos")


def every_other_in_range(selected: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """Selected pages at an even distance from the base page, within the contiguous run that holds it."""
    run = F.col("pos") - F.row_number().over(W.partitionBy(*by).orderBy("pos"))
    runs = selected.withColumn("_run", run)
    at = runs.join(base, [*by, "page_id"], "left_semi").groupBy(*by, "_run").agg(F.min("pos").alias("base_pos"))
    return runs.join(at, [*by, "_run"]).filter("(pos - base_pos) % 2 = 0").drop("base_pos", "_run")


def ranges(selected: DataFrame, by: list[str]) -> DataFrame:
    """Contiguous runs of selected positions: first, last, number."""
    run = F.col("pos") - F.row_number().over(W.partitionBy(*by).orderBy("pos"))
    return selected.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def color_filter(mode: Column, wanted: dict[str, bool]) -> Column:
    return mode.isin(*[m for m in FILTER_MODES if wanted.get(m)])


def dpi_status(w: Column, h: Column, dpi_x: Column, dpi_y: Column) -> Column:
    """The first that holds: undefined, too_small, too_large, too_small_for_pixels, ok."""
    either = lambda test: test(dpi_x) | test(dpi_y)
    large = ((w * 25.4 / dpi_x) > 500) | ((h * 25.4 / dpi_y) > 500)
    return (
        F.when(either(lambda d: d <= 1), "undefined").when(either(lambda d: d < 150), "too_small").when(either(lambda d: d > 9999), "too_large")
        .when(large, "too_small_for_pixels").otherwise("ok")
    )


def all_dpi_ok(images: DataFrame) -> DataFrame:
    return images.agg(F.coalesce(F.bool_and(dpi_status(*map(F.col, ("w", "h", "dpi_x", "dpi_y"))) == "ok"), F.lit(True)).alias("all_ok"))


def advised_pages(w: Column, h: Column, dpi_x: Column, dpi_y: Column, rotation: Column) -> Column:
    """2 when the image is wider than high in physical size after rotation, else 1."""
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.when(F.when(turned, h * dpi_x > w * dpi_y).otherwise(w * dpi_y > h * dpi_x), 2).otherwise(1)


def missing_params(pages: DataFrame, params: DataFrame, key: str, ignore: Column | None = None) -> DataFrame:
    """Pages without a row of parameters, but for those to ignore."""
    left = pages.join(params.select(key), key, "left_anti")
    return left if ignore is None else left.filter(~ignore)


def drop_orphans(params: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Parameters whose page exists."""
    return params.join(pages.select(key), key, "left_semi")


def remove_pages(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Images with what is left of them after pages (image_id, sub) go: one of two halves leaves the other; images without pages go."""
    left = pages.join(removed, ["image_id", "sub"], "left_anti")
    return left.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("n_left"), F.array_sort(F.collect_set("sub")).alias("subs"))


def unremove_half(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images (image_id, n_pages, removed) with a removed half restored where (image_id, sub) asks for it."""
    ask = wanted.select("image_id", F.col("sub").alias("_sub"))
    back = images.join(ask, "image_id", "left")
    return back.withColumn("removed", F.when((F.col("n_pages") == 2) & F.col("removed").eqNullSafe(F.col("_sub")), None).otherwise(F.col("removed"))).drop("_sub")


def insert_images(images: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``images`` (by, image_id, pos) with ``new`` (by, image_id, at_id, side before/after, seq) put next to existing ones; positions from 0."""
    near = images.select(*by, F.col("image_id").alias("at_id"), F.col("pos").alias("_at"))
    side = F.when(F.col("side") == "before", -1).otherwise(1)
    placed = new.join(near, [*by, "at_id"]).select(*by, "image_id", F.col("_at").alias("_pos"), side.alias("_side"), F.col("seq").alias("_seq"))
    both = images.select(*by, "image_id", F.col("pos").alias("_pos"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_seq")).unionByName(placed.withColumn("_seq", F.col("_seq").cast("long")))
    return both.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("_pos", "_side", "_seq")) - 1).select(*by, "image_id", "pos")


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``old`` with the columns of ``new`` where it has them."""
    fresh = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(fresh, key, "left").select(*key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns])


def relink(paths: DataFrame, old: str, new: str, column: str = "path") -> DataFrame:
    """Every path under the prefix ``old`` moved to ``new``."""
    p = F.col(column)
    return paths.withColumn(column, F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, len(old) + 1, 1 << 30))).otherwise(p))


def normalize_path(path: Column) -> Column:
    """Forward slashes, none repeated or at the end, no ``.`` steps, ``..`` resolved; null where that leaves the root or a drive."""

    def step(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        stuck = last.isNull() | (last == "") | last.endswith(":")
        up = F.when(stuck, F.lit(None)).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        empty = F.when(F.size(done) == 0, F.array(part)).otherwise(done)
        return F.when(done.isNull(), F.lit(None)).when(part == "", empty).when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def output_name(base: Column, label: Column, page: Column, sub: Column, ext: str = ".tif") -> Column:
    """base[(label)][_pageNNNN][_1L or _2R].ext; a label or page of 0 isn't shown."""
    return F.concat(
        base, F.when(label > 0, F.concat(F.lit("("), label.cast("string"), F.lit(")"))).otherwise(""),
        F.when(page > 0, F.concat(F.lit("_page"), F.lpad(page.cast("string"), 4, "0"))).otherwise(""),
        F.when(sub == "left", "_1L").when(sub == "right", "_2R").otherwise(""), F.lit(ext),
    )


def existing_output(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Of each wanted base name the existing file (name) whose extension comes first."""
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.concat(F.lit("."), F.substring_index("name", ".", -1)))
    known = files.withColumn("_rank", rank).filter("_rank > 0").withColumn("base", F.expr("substring(name, 1, length(name) - 4)"))
    best = known.groupBy("base").agg(F.min_by("name", "_rank").alias("found"))
    return wanted.join(best, "base", "left")


def disambiguate(files: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Files with a label that tells equal names apart: 0, 1, 2 in order of registration."""
    return files.withColumn("label", F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1)


def color_policy(mode: Column, policy: str) -> Column:
    """The mode that takes effect: best_guess keeps it, never_color turns color and mixed to gray, force_bw gives bw."""
    if policy == "force_bw":
        return F.lit("bw")
    return F.when(mode.isin("color", "mixed"), "gray").otherwise(mode) if policy == "never_color" else mode


def clear_automatic(df: DataFrame) -> DataFrame:
    """Color decisions (mode, automatic) without the automatic ones; manual ones stay."""
    return df.withColumns({"mode": F.when(~F.col("automatic"), F.col("mode")), "automatic": F.lit(False)})


def convert_units(value: Column, dpi: Column, source: str, target: str) -> Column:
    """Lengths between px, mm, cm and in."""
    inches = {"px": value / dpi, "mm": value / 25.4, "cm": value / 2.54, "in": value}[source]
    return {"px": inches * dpi, "mm": inches * 25.4, "cm": inches * 2.54, "in": inches}[target]


def rotate_size(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    turned = F.pmod(degrees, F.lit(180)) == 90
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def rotate_point(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """A point of an image of size w x h after a clockwise turn by a multiple of 90 degrees."""
    d = F.pmod(degrees, F.lit(360))
    return F.when(d == 90, h - y).when(d == 180, w - x).when(d == 270, y).otherwise(x), F.when(d == 90, x).when(d == 180, h - y).when(d == 270, w - x).otherwise(y)


def affine(*steps: Column) -> Column:
    """The product of 3 x 3 row-major matrices (array<double>), the first step applied first."""
    out = steps[0]
    for m in steps[1:]:
        cell = lambda a, i, b, j: sum(b[3 * i + k] * a[3 * k + j] for k in range(3))
        out = F.array(*[cell(out, i, m, j) for i in range(3) for j in range(3)])
    return out


def apply_affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def crop_and_scale(x0: Column, y0: Column, scale_x: Column, scale_y: Column) -> tuple[Column, Column]:
    """Matrices that move a crop's corner to the origin, and that scale."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one, zero, -x0, zero, one, -y0, zero, zero, one), F.array(scale_x, zero, zero, zero, scale_y, zero, zero, zero, one)


def rotation_matrix(degrees: Column) -> Column:
    c, s, zero, one = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, s, c, zero, zero, zero, one)
