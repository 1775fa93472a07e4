"""Project files: XML with surrogate ids to tables and back; sidecars; metrics.

Reading resolves the ids (directory, file, image, page) by equi-joins; writing numbers them anew.
"""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 4
ATTRIBUTES = {
    "directory": "_id int, _path string",
    "file": "_id int, _dirId int, _name string",
    "image": "_id int, _fileId int, _fileImage int, _subPages int, size struct<_width:int,_height:int>, dpi struct<_horizontal:int,_vertical:int>",
    "page": "_id int, _imageId int, _subPage string",
}


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """All pages of the project files under ``path`` (one, or many of one project): path of the image, size, resolution, sub-page."""
    t = {k: _rows(spark, path, k, v) for k, v in ATTRIBUTES.items()}
    files = t["file"].select(F.col("_id").alias("file_id"), F.col("_dirId").alias("dir_id"), F.col("_name").alias("name"))
    dirs = t["directory"].select(F.col("_id").alias("dir_id"), F.col("_path").alias("dir"))
    images = t["image"].select(F.col("_id").alias("image_id"), F.col("_fileId").alias("file_id"), F.col("_fileImage").alias("file_page"), F.col("_subPages").alias("sub_pages"), F.col("size._width").alias("w"), F.col("size._height").alias("h"), F.col("dpi._horizontal").alias("dpi_x"), F.col("dpi._vertical").alias("dpi_y"))
    pages = t["page"].select(F.col("_id").alias("page_id"), F.col("_imageId").alias("image_id"), F.col("_subPage").alias("sub"))
    full = pages.join(images, "image_id").join(files, "file_id").join(dirs, "dir_id")
    return full.select("page_id", "image_id", F.concat_ws("/", "dir", "name").alias("path"), "file_page", "sub", "sub_pages", "w", "h", "dpi_x", "dpi_y")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """Version and layout direction; a version other than VERSION isn't supported."""
    return _rows(spark, path, "project", "_version int, _layoutDirection string, _outputDirectory string").select(F.col("_version").alias("version"), F.col("_layoutDirection").alias("direction"), F.col("_outputDirectory").alias("output"), (F.col("_version") == VERSION).alias("is_supported"))


def read_stage(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The parameters of one stage: a row for each ``tag`` element, with attributes as ``_name``."""
    return _rows(spark, path, tag, schema)


def surrogates(pages: DataFrame) -> DataFrame:
    """Pages (path, file_page, sub) with numbered directories, files, images and pages.

    Each level is numbered over its own distinct values, a small table, and joined back.
    """
    name = F.substring_index("path", "/", -1)
    rows = pages.withColumns({"dir": F.expr("substring(path, 1, greatest(length(path) - length(substring_index(path, '/', -1)) - 1, 0))"), "name": name})
    levels = (("dir_id", ["dir"]), ("file_id", ["dir", "name"]), ("image_id", ["dir", "name", "file_page"]), ("page_id", ["dir", "name", "file_page", "sub"]))
    for key, columns in levels:
        ids = rows.select(*columns).distinct().select(*columns, F.dense_rank().over(_order(columns)).alias(key))
        rows = rows.drop(key).join(ids, columns)
    return rows


def _order(columns: list[str]):
    from pyspark.sql import Window as W

    return W.orderBy(*columns)


def write_pages(pages: DataFrame, path: str) -> None:
    """A project's pages as XML part files, one element for each page with its ids."""
    rows = surrogates(pages)
    parts = rows.select(F.col("page_id").alias("_id"), F.col("image_id").alias("_imageId"), F.col("sub").alias("_subPage"))
    parts.write.format("xml").option("rowTag", "page").option("rootTag", "project").mode("overwrite").save(f"{path}/pages")
    images = rows.select(F.col("image_id").alias("_id"), F.col("file_id").alias("_fileId"), F.col("file_page").alias("_fileImage"), F.struct(F.col("w").alias("_width"), F.col("h").alias("_height")).alias("size"), F.struct(F.col("dpi_x").alias("_horizontal"), F.col("dpi_y").alias("_vertical")).alias("dpi"), F.col("sub_pages").alias("_subPages")).distinct()
    images.write.format("xml").option("rowTag", "image").option("rootTag", "project").mode("overwrite").save(f"{path}/images")
    rows.select(F.col("file_id").alias("_id"), F.col("dir_id").alias("_dirId"), F.col("name").alias("_name")).distinct().write.format("xml").option("rowTag", "file").option("rootTag", "project").mode("overwrite").save(f"{path}/files")
    rows.select(F.col("dir_id").alias("_id"), F.col("dir").alias("_path")).distinct().write.format("xml").option("rowTag", "directory").option("rootTag", "project").mode("overwrite").save(f"{path}/directories")


SIDECAR = "version int, item struct<key:string,title:string,libraryId:int>, attachment struct<key:string,path:string>, workDir string"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Round-trip requests: JSON files with a fixed schema; those without an item key are invalid."""
    rows = spark.read.schema(SIDECAR).option("multiLine", "true").json(path)
    return rows.withColumn("is_valid", F.col("item.key").isNotNull() & F.col("attachment.path").isNotNull())


def metrics_json(stages: DataFrame) -> DataFrame:
    """Stage timings (run, stage, ms, pages) as one JSON text for each run."""
    per = stages.groupBy("run").agg(F.sum("ms").alias("total_ms"), F.max("pages").alias("pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("stages"))
    return per.select("run", F.to_json(F.struct("run", "total_ms", "pages", (F.col("total_ms") / F.greatest("pages", F.lit(1))).alias("ms_per_page"), "stages")).alias("json"))


def project_folder(path: str, create: bool = False, extension: str = ".xml") -> dict[str, str]:
    """Where a project folder keeps its file (named like the folder, with the extension that the caller's files have), originals, cache and output; ``create`` makes the folders that are missing."""
    base = os.path.abspath(path)
    folders = {name: os.path.join(base, name) for name in ("originals", "cache", "output")}
    if create:
        for folder in folders.values():
            os.makedirs(folder, exist_ok=True)
    return {"project": os.path.join(base, os.path.basename(base) + extension), **folders}


def copy_original(source: str, path: str) -> str | None:
    """Copy an image into the project's originals; a name that is taken gets _1, _2 and so on before its last suffix. None without a source."""
    if not os.path.exists(source):
        return None
    stem, dot, suffix = os.path.basename(source).rpartition(".")
    if not dot:
        stem, suffix = suffix, ""
    folder, name, n = project_folder(path, create=True)["originals"], os.path.basename(source), 0
    while os.path.exists(os.path.join(folder, name)):
        n += 1
        name = f"{stem}_{n}{'.' if suffix else ''}{suffix}"
    return shutil.copyfile(source, os.path.join(folder, name))
