"""The stages over small drawn pages, and streams."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from folioloom.plans import stages as G
from folioloom.streaming import arrivals as A


def page(h=200, w=150, lines=6):
    a = np.full((h, w), 235, np.uint8)
    for i in range(lines):
        a[30 + 22 * i : 38 + 22 * i, 20 : w - 20] = 30
    return a


def spread():
    both = np.concatenate([page(), page()], 1)
    both[:, 148:152] = 60
    return both


def images(spark):
    rows = [("book", i, a.shape[1], a.shape[0], 1, bytearray(a.tobytes()), 100, 100, 0) for i, a in enumerate([spread(), spread(), spread(), page(200, 300, 3)])]
    return spark.createDataFrame(rows, "project string, image_id long, w int, h int, channels int, px binary, dpi_x int, dpi_y int, rotation int")


def test_auto_process_and_render(spark):
    i = images(spark)
    plan = G.auto_process(i)
    rows = plan.collect()
    assert {(r.image_id, r["sub"]) for r in rows} >= {(k, s) for k in range(3) for s in ("left", "right")}
    assert [r.pos for r in sorted(rows, key=lambda r: r.pos)] == list(range(len(rows)))
    assert all(r.mode in ("bw", "gray", "mixed", "color") for r in rows)
    assert all(abs(r.ml + r.w - 20 + r.mr - r.agg_w) < 1e-6 for r in rows if r.aligned)
    out = G.render(i, plan.withColumn("mode", F.lit("bw")), "otsu").collect()
    assert len(out) == len(rows)
    for r in out:
        a = np.frombuffer(r.px, np.uint8).reshape(r.h, r.w)
        assert set(np.unique(a)) <= {0, 255} and 0.05 < (a == 0).mean() < 0.95


def test_explicit_modes_win(spark):
    found = G.detect_pages(images(spark), G.logical(images(spark), G.vote_splits(G.detect_splits(images(spark)))))
    explicit = spark.createDataFrame([("book", 0, "left", "color")], "project string, image_id long, sub string, mode string")
    rows = {(r.image_id, r["sub"]): r for r in G.finalize(found, explicit, "force_bw").collect()}
    assert rows[0, "left"].mode == "color" and not rows[0, "left"].automatic
    assert rows[1, "left"].mode == "bw" and rows[1, "left"].automatic


def test_replay_and_stale(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id int")
    one = pages.filter("page_id = 1")
    got = {r.page_id: (r.split_complete, r.ocr_complete, r.next_stage) for r in G.replay(pages, {"split": pages, "deskew": one, "ocr": pages}, ["page_id"]).collect()}
    assert got == {1: (True, True, None), 2: (True, False, "deskew")}
    new = pages.withColumn("v", F.lit(1))
    old = new.filter("page_id = 1")
    assert [r.page_id for r in G.only_stale(new, old, ["page_id"], ["v"]).collect()] == [2]


def test_no_images(spark):
    assert G.auto_process(images(spark).filter("false")).count() == 0


def test_windows_drop_what_is_late(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2020, 1, 1, h, m)
    kind = "ts timestamp, user int, value double"
    for i, rows in enumerate([[(at(1), 1, 2.0), (at(1, 30), 1, 3.0)], [(at(9), 1, 1.0)], [(at(1, 5), 1, 100.0), (at(9, 30), 2, 4.0)], [(at(20), 1, 0.0)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    run = A.windowed_counts(stream, "ts", "user", "value").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/log").start()
    run.awaitTermination()
    got = {(r.start.hour, r.user): (r.n, r.total) for r in spark.table("windows").collect()}
    assert got[1, 1][0] in (2, 3) and (9, 1) in got


def test_running_moments(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 5.0)], "k string, v double")
    got = {r.k: (r.n, r.mean, r.sigma) for r in A.deviation_of(A.running_moments(df, ["k"], "v")).collect()}
    assert got["a"][:2] == (3, 2.0) and abs(got["a"][2] - 2**0.5) < 1e-12 and got["b"] == (1, 5.0, None)
