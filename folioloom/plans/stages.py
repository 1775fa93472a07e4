"""The stages that bring scanned images to finished pages, as DataFrames.

A stage takes and gives a DataFrame. Pixel work runs in one Arrow map for each barrier, so an image is
read once between two project-wide decisions: splits are voted on after the first map, sizes after the
second. Each map only runs over pages whose stored result is missing or stale. Relational steps
(votes, aggregates, layout, policy) never carry pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import rules
from ..operators import layout as L
from ..operators import pages as P
from ..operators import staleness as S

#: Versions of the automatic detectors; stored automatic results of others are stale.
VERSIONS = {"split": 3, "content": 2, "color": 2}
MM = 25.4


def raster(w: int, h: int, channels: int, px: bytes) -> np.ndarray:
    return np.frombuffer(px, np.uint8).reshape((h, w, 3) if channels == 3 else (h, w))


def map_pages(df: DataFrame, f: Callable[[dict, np.ndarray], list[dict]], schema: str) -> DataFrame:
    """``f`` of each row (a dict without pixels) and its raster gives any number of rows. One image is in memory at a time."""
    kinds = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                px = row.pop("px")
                if px is None:
                    continue
                rows = f(row, raster(row["w"], row["h"], row["channels"], px))
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in arrow.names} for r in rows], schema=arrow)

    return df.mapInArrow(of, schema)


# --- 1 and 2: orientation and split ----------------------------------------------------------------------

SPLIT = "project string, image_id long, split boolean, cut double, plate boolean, rotation int"


def detect_splits(images: DataFrame) -> DataFrame:
    """Images (project, image_id, w, h, channels, px, dpi_x, dpi_y, rotation) to a verdict and where to cut, after the rotation.

    A fold is a dark column in the middle third, else the widest gap between columns of content; a
    plate isn't cut, and an image that is higher than wide has one page.
    """

    def one(row: dict, a: np.ndarray) -> list[dict]:
        g = np.rot90(K.luma(a), -(row["rotation"] or 0) // 90)
        plate = K.is_plate(g)[0]
        wide = g.shape[1] > g.shape[0]
        at, _ = K.spine(g)
        if at < 0:
            ink = (g < K.otsu(K.histogram(g))).sum(0) > 1
            gaps = np.flatnonzero(~ink[g.shape[1] // 3 : g.shape[1] - g.shape[1] // 3])
            at = int(gaps[len(gaps) // 2]) + g.shape[1] // 3 if len(gaps) else -1
        split = bool(wide and at >= 0 and not plate)
        return [{**row, "split": split, "cut": float(at) if split else None, "plate": bool(plate), "rotation": row["rotation"] or 0}]

    return map_pages(images, one, SPLIT)


def vote_splits(detected: DataFrame) -> DataFrame:
    """Detected splits with the project's majority: the minority is turned, a tie changes nothing. A page that becomes split is cut in its middle."""
    votes = L.majority_vote(detected.select("project", "image_id", "split"), ["project"]).select("project", "verdict")
    final = F.when(F.col("verdict") == "none", F.col("split")).otherwise(F.col("verdict") == "split")
    return detected.join(votes, "project").withColumn("split", final & ~F.col("plate")).withColumn("cut", F.when(F.col("split"), F.col("cut"))).drop("verdict")


def logical(images: DataFrame, splits: DataFrame, right_to_left: bool = False) -> DataFrame:
    """Logical pages (project, image_id, sub, pos) of split images, without pixels."""
    i = images.select("project", "image_id", F.lit(None).cast("string").alias("removed")).join(splits.select("project", "image_id", "split", "cut", "rotation"), ["project", "image_id"], "left")
    pages = P.logical_pages(i.withColumn("n_pages", F.when(F.col("split"), 2).otherwise(1)), right_to_left)
    return P.positions(pages, ["image_id", "sub_pos"], ["project"]).drop("sub_pos", "removed")


# --- 3, 4, 5 and the evidence of 7: one map over each image's pages ------------------------------------------

DETECTED = (
    "project string, image_id long, sub string, angle double, angle_confidence double, page_x int, page_y int, page_w int, page_h int, x int, y int, cw int, ch int, "
    "mm_w double, mm_h double, is_gray boolean, dark float, mid float, light float, coverage float, largest float, tiles int, region_tiles int, detector int"
)


def crop(a: np.ndarray, row: dict) -> np.ndarray:
    """The half of an image that a sub-page is, after rotation."""
    a = np.rot90(a, -(row.get("rotation") or 0) // 90)
    if row["sub"] == "single":
        return a
    cut = int(row["cut"] if row.get("cut") is not None else a.shape[1] / 2)
    cut = min(max(1, cut), a.shape[1] - 1)
    return a[:, :cut] if row["sub"] == "left" else a[:, cut:]


def detect_pages(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Skew, page box, content box and tone evidence of each page, from one reading of its image."""

    def one(row: dict, a: np.ndarray) -> list[dict]:
        part = crop(a, row)
        if part.size == 0:
            return []
        g = K.luma(part)
        plate = K.is_plate(g)[0]
        angle, sure = (0.0, 0.0) if plate else K.skew(K.binarize(g, "otsu"))
        px0, py0, px1, py1 = K.page_box(g)
        if px1 <= px0 or py1 <= py0:
            px0, py0, px1, py1 = 0, 0, g.shape[1], g.shape[0]
        dpi = row["dpi_x"] or 300
        box = K.content_box(np.ascontiguousarray(g[py0:py1, px0:px1]), dpi)
        x0, y0, x1, y1 = box or (0, 0, 0, 0)
        return [{
            **row, "angle": angle if sure >= 2 else 0.0, "angle_confidence": sure, "page_x": px0, "page_y": py0, "page_w": px1 - px0, "page_h": py1 - py0,
            "x": px0 + x0 if box else None, "y": py0 + y0 if box else None, "cw": x1 - x0 if box else None, "ch": y1 - y0 if box else None,
            "mm_w": (x1 - x0) * MM / dpi if box else None, "mm_h": (y1 - y0) * MM / (row["dpi_y"] or dpi) if box else None, **K.compensated_evidence(part), "detector": VERSIONS["content"],
        }]

    joined = pages.select("project", "image_id", "sub", "cut", "rotation").join(images.drop("rotation"), ["project", "image_id"])
    return map_pages(joined, one, DETECTED)


def only_stale(pages: DataFrame, stored: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Pages whose stored result is missing or was made from something else."""
    flags = S.stale(stored, pages, key, compare).filter("is_stale").select(*key)
    return pages.join(flags, key, "left_semi")


# --- 6: layout -----------------------------------------------------------------------------------------------


def lay_out(detected: DataFrame, margins: tuple[float, float, float, float] = (10.0, 5.0, 10.0, 5.0), outlier: float = 1.3) -> DataFrame:
    """Sizes in mm, margins (left, top, right, bottom) and soft margins of each project's pages; pages of an outlying size aren't aligned."""
    left, top, right, bottom = margins
    rows = detected.withColumns({"w": F.col("mm_w") + left + right, "h": F.col("mm_h") + top + bottom})
    sized = rows.filter("w is not null and h is not null").groupBy("project").agg(F.median("w").alias("_mw"), F.median("h").alias("_mh"), F.count(F.lit(1)).alias("_n"))
    ratio = F.col("w") * F.col("h") / (F.col("_mw") * F.col("_mh"))
    off = (F.col("_n") >= 2) & F.when(ratio > 1, ratio >= outlier).otherwise(ratio <= 1 / outlier)
    rows = rows.join(sized, "project", "left").withColumn("aligned", F.coalesce(~off, F.lit(False)))
    most = rows.groupBy("project").agg(*[F.coalesce(F.max(F.when(F.col("aligned"), F.col(c))), F.lit(0.0)).alias(f"agg_{c}") for c in ("w", "h")])
    rows = rows.join(most, "project")
    align = F.when(F.col("aligned"), "auto")
    cx = (F.col("x") + F.col("cw") / 2 - F.col("page_x")) / F.col("page_w")
    cy = (F.col("y") + F.col("ch") / 2 - F.col("page_y")) / F.col("page_h")
    sl, sr = L.soft_margins(F.col("agg_w") - F.col("w"), cx, F.col("agg_w"), F.col("w"), align, ("left", "right"))
    st, sb = L.soft_margins(F.col("agg_h") - F.col("h"), cy, F.col("agg_h"), F.col("h"), align, ("top", "bottom"))
    return rows.withColumns({"ml": F.lit(left) + sl, "mr": F.lit(right) + sr, "mt": F.lit(top) + st, "mb": F.lit(bottom) + sb}).drop("_mw", "_mh", "_n")


# --- 7: colour mode --------------------------------------------------------------------------------------------


def finalize(detected: DataFrame, explicit: DataFrame | None = None, policy: str = "best_guess") -> DataFrame:
    """The mode of each page: an explicit one, else the classifier's, under the policy; the verdict itself is kept beside it."""
    e = F.struct("is_gray", "dark", "mid", "light", "coverage", "largest", "tiles", "region_tiles")
    rows = detected.withColumns({"verdict": rules.color_class(e), "reason": rules.color_reason(e)})
    if explicit is not None:
        rows = rows.join(explicit.select("project", "image_id", "sub", F.col("mode").alias("_explicit")), ["project", "image_id", "sub"], "left")
        mode = F.coalesce("_explicit", P.color_policy(F.col("verdict"), policy))
        return rows.withColumn("mode", mode).withColumn("automatic", F.col("_explicit").isNull()).drop("_explicit")
    return rows.withColumn("mode", P.color_policy(F.col("verdict"), policy)).withColumn("automatic", F.lit(True))


# --- 8: output ---------------------------------------------------------------------------------------------------

OUTPUT = "project string, image_id long, sub string, mode string, path string, w int, h int, channels int, px binary"


def render(images: DataFrame, plan: DataFrame, method: str = "sauvola", despeckle: float = 2.0, dewarp: bool = False, balance: bool = False) -> DataFrame:
    """Finished rasters: cropped, turned by the skew, illumination evened out, then bits, gray or colour by mode; specks go last.

    ``plan`` has the detected boxes and modes. Mixed pages keep their pictures in gray.
    """

    def one(row: dict, a: np.ndarray) -> list[dict]:
        part = np.ascontiguousarray(crop(a, row))
        if balance and part.ndim == 3 and (paper := K.paper_of(part)):
            part = K.white_balance(part, paper)
        if row["angle"]:
            c, s = np.cos(np.radians(row["angle"])), np.sin(np.radians(row["angle"]))
            cy, cx = part.shape[0] / 2, part.shape[1] / 2
            m = np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1]])
            part = K.transform(part, m, *part.shape[:2])
        if dewarp:
            top, bottom = K.page_edges(K.luma(part))
            step = max(1, len(top) // 8)
            part = K.dewarp(part, top[::step], bottom[::step], *part.shape[:2])
        if row["x"] is not None:
            part = part[row["y"] : row["y"] + row["ch"], row["x"] : row["x"] + row["cw"]]
        if part.size == 0:
            return []
        g = K.luma(np.ascontiguousarray(part))
        if row["mode"] == "color" and part.ndim == 3:
            out = np.ascontiguousarray(part)
        elif row["mode"] in ("gray", "color"):
            out = g
        else:
            b = K.despeckle(K.binarize(K.flatten(g), method), row["dpi_x"] or 300, despeckle)
            out = np.where(b, 0, 255).astype(np.uint8)
            if row["mode"] == "mixed":
                out = np.where(K.picture_mask(g), g, out).astype(np.uint8)
        return [{**row, "w": out.shape[1], "h": out.shape[0], "channels": 3 if out.ndim == 3 else 1, "px": np.ascontiguousarray(out).tobytes(), "path": row["name"]}]

    name = P.output_name(F.concat(F.lit("page"), F.col("image_id").cast("string")), F.lit(0), F.lit(0), F.col("sub"), "")
    wanted = plan.select("project", "image_id", "sub", "angle", "x", "y", "cw", "ch", "mode", "cut", "rotation", name.alias("name"))
    return map_pages(wanted.join(images.drop("rotation"), ["project", "image_id"]), one, OUTPUT)


# --- the whole plan ------------------------------------------------------------------------------------------------


def auto_process(images: DataFrame, explicit: DataFrame | None = None, policy: str = "best_guess", right_to_left: bool = False, checkpoint: bool = True) -> DataFrame:
    """From images to a plan of finished pages: split, voted, detected, laid out, with a mode. No pixels in the result.

    The two barriers are checkpointed, so that what was detected isn't detected again when an executor
    is lost; ``spark.checkpoint.dir`` must name a folder that all executors share.
    """
    keep = (lambda df: df.checkpoint()) if checkpoint else (lambda df: df)
    splits = vote_splits(keep(detect_splits(images)))
    pages = logical(images, splits, right_to_left)
    found = keep(detect_pages(images, pages))
    plan = finalize(lay_out(found), explicit, policy)
    return plan.join(pages.select("project", "image_id", "sub", "pos", "cut", "rotation"), ["project", "image_id", "sub"])


def replay(pages: DataFrame, stored: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Without pixels: which pages are complete in each stage, and the first stage that isn't. A stage needs all before it."""
    out, done = pages.select(*key), F.lit(True)
    for name, params in stored.items():
        out = out.join(params.select(*key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
        done = done & F.coalesce(f"_{name}", F.lit(False))
        out = out.withColumn(f"{name}_complete", done)
    first = F.coalesce(*[F.when(~F.col(f"{n}_complete"), n) for n in stored])
    return out.withColumn("next_stage", first).drop(*[f"_{n}" for n in stored])


def with_recognised(pages: DataFrame, words: DataFrame, cached: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Recognised words of pages whose cached result still holds; recognition itself is a table or a function given from outside."""
    valid = S.stale(cached, current, key, list(S.OCR_KEY)).filter("not is_stale").select(*key)
    return pages.join(valid, key, "left_semi").join(words, key)
