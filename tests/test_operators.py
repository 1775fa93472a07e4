"""Known values, ties, nulls and empty tables of the relational operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.functions import rules
from folioloom.functions import text as X
from folioloom.operators import layout as L
from folioloom.operators import orders as O
from folioloom.operators import pages as P
from folioloom.operators import raster as R
from folioloom.operators import spans as S
from folioloom.operators import staleness as T


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")


@pytest.mark.parametrize(("value", "factor", "percent", "want"), [(10.0, 1, 0, True), (2.0, 1, 0, False), (10.0, 1.5, 0, False), (10.0, 1, 100, True), (10.0, 0, 200, False)])
def test_deviant(spark, value, factor, percent, want):
    d = L.deviation(frame(spark, [1.0, 2.0, 3.0, 10.0]), "v").filter(F.col("v") == value)
    row = d.select(L.is_deviant(F.col("v"), F.col("stats"), factor, percent).alias("x"), "stats").first()
    assert row.x is want and row.stats.mean == 4 and row.stats.sigma == pytest.approx(math.sqrt(50 / 3))


def test_deviation_of_few_and_nan(spark):
    value = lambda vs: {r.v if r.v == r.v else "nan": r.d for r in L.deviation(frame(spark, vs), "v").withColumn("d", L.deviation_value(F.col("v"), F.col("stats"))).collect()}
    assert value([1.0, 3.0, float("nan"), 5.0]) == {1.0: 2, 3.0: 0, "nan": -1, 5.0: 2}
    assert value([1000.0]) == {1000.0: 0}
    assert value([1000.0, 0.0]) == {1000.0: 500, 0.0: 500}
    two = L.deviation(frame(spark, [1000.0, 0.0]), "v")
    assert not any(r.x for r in two.select(L.is_deviant(F.col("v"), F.col("stats"), 0.1).alias("x")).collect())


def sizes(spark, rows):
    return spark.createDataFrame(rows, "page_id int, w double, h double, aligned boolean")


def test_aggregate_and_what_if(spark):
    p = sizes(spark, [(1, 10.0, 5.0, True), (2, 8.0, 9.0, True), (3, 99.0, 99.0, False)])
    assert tuple(L.aggregate_size(p).first()) == (10, 9)
    got = {r.page_id: (r.agg_w, r.agg_h) for r in L.aggregate_what_if(p, F.lit(20.0), F.lit(1.0)).collect()}
    assert got == {1: (20, 9), 2: (10, 5), 3: (10, 9)}  # only the present maximum moves the aggregate
    assert tuple(L.aggregate_size(p.filter("false")).first()) == (0, 0)


def test_outliers_need_two(spark):
    assert L.outliers(sizes(spark, [(1, 10.0, 5.0, True)]), 1.3).count() == 0
    rows = sizes(spark, [(1, 10.0, 10.0, True), (2, 10.0, 10.0, True), (3, 20.0, 10.0, True), (4, 5.0, 5.0, True), (5, 90.0, 90.0, False)])
    assert {r.page_id: r.ratio for r in L.outliers(rows, 1.3).collect()} == {3: 2.0, 4: 0.25}


def test_vote_ties(spark):
    v = spark.createDataFrame([("a", 1, True), ("a", 1, False), ("a", 2, None), ("b", 1, True)], "p string, image_id int, split boolean")
    assert {r.p: (r.verdict, r.n_flipped) for r in L.majority_vote(v, ["p"]).collect()} == {"a": ("none", 0), "b": ("split", 0)}


def test_content_spans(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([0, 1, 0, 1, 1, 1, 0, 1, 1])], "k string, i int, n int")
    assert sorted((r.b, r.e) for r in S.content_spans(df, ["k"], 2, 1).collect()) == [(3, 6), (7, 9)]
    assert sorted((r.b, r.e) for r in S.content_spans(df, ["k"], 2, 2).collect()) == [(1, 9)]


def test_edge_spans(spark):
    s = spark.createDataFrame([("a", 0, 2), ("a", 10, 60), ("a", 70, 73)], "k string, b int, e int")
    assert sorted((r.b, r.e) for r in S.drop_edge_spans(s, ["k"]).collect()) == [(10, 60), (70, 73)]
    assert S.drop_edge_spans(s.filter("b = 0"), ["k"]).count() == 1


def test_edges_and_interpolation(spark):
    dark = [10, 10, 2, 10] + [0] * 11 + [10]
    lines = spark.createDataFrame([("a", i, n, 10) for i, n in enumerate(dark)] + [("b", 0, 0, 10)], "k string, i int, black int, pixels int")
    assert {r.k: r.edge for r in S.detect_edge(lines, ["k"]).collect()} == {"a": 3, "b": -1}
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("a", 3.0, 4.0), ("a", 6.0, 4.0)], "k string, x double, y double")
    want = spark.createDataFrame([("a", -1.0), ("a", 1.5), ("a", 6.0), ("a", 9.0)], "k string, x double")
    got = {r.x: r.length for r in S.interpolate(S.arc_length(pts, ["k"]), want, ["k"]).collect()}
    assert got == {-1.0: 0, 1.5: 2.5, 6.0: 8, 9.0: 8}


def test_natural_order(spark):
    names = ["a010_2", "a10_10", "a_1", "a_0002", "010", "10", "1", "2", "b/x", "a99999999999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(*O.natural_order("name")).collect()]
    before = lambda a, b: got.index(a) < got.index(b)
    assert before("a_1", "a_0002") and before("a010_2", "a10_10") and before("010", "10") and before("1", "2") and before("1", "a_1")


def test_dpi_order(spark):
    df = spark.createDataFrame([(1000, 1000, 0, 300), (1000, 1000, 100, 300), (1000, 1000, 300, 10000), (90000, 100, 300, 300), (1000, 1000, 300, 300)], "w int, h int, x int, y int")
    got = [r[0] for r in df.select(P.dpi_status(F.col("w"), F.col("h"), F.col("x"), F.col("y"))).collect()]
    assert got == ["undefined", "too_small", "too_large", "too_small_for_pixels", "ok"]
    assert P.all_dpi_ok(df.select("w", "h", F.col("x").alias("dpi_x"), F.col("y").alias("dpi_y")).filter("false")).first()[0] is True


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_isbn(spark):
    find = lambda s: one(spark, X.find_isbn(F.lit(s)))
    assert find("ISBN 0-306-40615-2, later ISBN-13: 978-0-306-40615-7") == "9780306406157"
    assert find("isbn 0-8044-2957-X and 978 0 306 40615 8") == "080442957X"
    assert find("no 978 0 306 40615 7 label") == "9780306406157"
    assert find("ISBN 0-306-40615-3") is None


def test_names_and_files(spark):
    assert one(spark, X.name_case(F.lit("ERIC  HOBSBAWM AND ANN"))) == "Eric Hobsbawm and Ann"
    assert one(spark, X.name_case(F.lit("Eric HOBSBAWM"))) == "Eric HOBSBAWM"
    assert one(spark, X.looks_like_name(F.lit("J. R. O'Neil-Smith"))) and not one(spark, X.looks_like_name(F.lit("one Two")))
    assert one(spark, X.pdf_name(F.lit("A"), F.lit(" b/c: ..d "), F.lit("1999"), F.lit("f"))) == "A - b c ..d (1999).pdf"
    assert one(spark, X.pdf_name(F.lit(None), F.lit(""), F.lit(None), F.lit("..."))) == "output.pdf"
    assert [one(spark, X.duration(F.lit(t))) for t in (-5, 1240, 61_000, 3_660_000)] == ["0.0 s", "1.2 s", "1 m 1 s (61 s)", "1 h 1 m (3660 s)"]
    assert one(spark, P.normalize_path(F.lit("a//b/./c\\d/"))) == "a/b/c/d"
    paths = {"/a/../b": "/b", "a/b/../..": "", "/..": None, "c:/..": None, "../a": None, "/": "", "": "", "//a/b/../c/.": "/a/c"}
    assert {k: one(spark, P.normalize_path(F.lit(k))) for k in paths} == paths


def test_lines_title_author(spark):
    words = [(1, t, float(x), float(y), 40.0, float(h), 0.9) for t, x, y, h in [("World", 60, 1, 20), ("Hello", 5, 0, 20), ("Ann", 5, 40, 10), ("Lee", 50, 41, 10)]]
    df = spark.createDataFrame(words, "page int, text string, x double, y double, w double, h double, conf double")
    lines = X.cluster_lines(df, ["page"])
    assert [(r.i, r.text) for r in lines.orderBy("i").collect()] == [(0, "Hello World"), (1, "Ann Lee")]
    assert X.pick_title(lines.withColumn("page_h", F.lit(100.0)), ["page"]).first().title == "Hello World"
    below = lines.withColumns({"title_i": F.lit(0), "title_height": F.lit(20.0)})
    assert X.positional_author(below, ["page"]).first().name == "Ann Lee"
    titled = lines.withColumn("is_title", F.col("i") == 0)
    assert X.merge_title(titled, ["page"]).first().title == "Hello World"


def test_rules(spark):
    e = lambda **k: F.struct(*[F.lit(v).alias(n) for n, v in ({"is_gray": True, "mid": 0.01, "dark": 0.2, "light": 0.5, "coverage": 0.0, "largest": 0.0, "tiles": 0, "region_tiles": 0} | k).items()])
    got = lambda **k: one(spark, rules.color_class(e(**k)))
    assert [got(), got(is_gray=False), got(mid=0.5), got(tiles=45), got(region_tiles=2, largest=0.1)] == ["bw", "color", "gray", "gray", "mixed"]
    assert max(abs(v - i) for i, v in enumerate(rules.tone_table())) <= 1  # values are cut
    assert rules.tone_table(exposure=1)[200] == 255 and rules.tone_table(blacks=100)[0] == 63


def test_staleness(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, None)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, None, None), (4, "d", 1)], "k int, x string, y int")
    assert {r.k: r.is_stale for r in T.stale(old, new, ["k"], ["x", "y"]).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_label_maps(spark):
    a = spark.createDataFrame([("p", 0, 0, 1), ("p", 0, 1, 2)], "k string, y int, x int, label int")
    b = spark.createDataFrame([("p", 0, 1, 1), ("p", 5, 5, 2)], "k string, y int, x int, label int")
    assert sorted(tuple(r) for r in T.add_components(a, b, ["k"]).collect()) == [("p", 0, 0, 1), ("p", 0, 1, 3), ("p", 5, 5, 4)]


def test_window_rules_match_the_kernels(spark):
    import numpy as np

    from folioloom.functions import kernels as K

    g = np.random.default_rng(1).integers(0, 256, (9, 11)).astype(np.uint8)
    px = spark.createDataFrame([(1, y, x, int(g[y, x])) for y in range(9) for x in range(11)], "img_id int, y int, x int, v int")
    for method in ("sauvola", "wolf", "bradley", "niblack", "nick", "singh", "wan", "fox", "window"):
        got = np.zeros(g.shape, bool)
        for r in R.local_threshold(px, method, 5, 4).collect():
            got[r.y, r.x] = r.b
        want = K.local_threshold(g, method, 5, 4)
        assert ((got == (g < want)) | np.isclose(g, want)).all(), method
    assert R.otsu(px).first().threshold == K.otsu(K.histogram(g))


def test_empty_rasters(spark):
    px = spark.createDataFrame([], "img_id int, y int, x int, v int")
    for df in (R.histogram(px), R.otsu(px), R.opened(px), R.local_threshold(px, "sauvola"), R.dominant_level(px), R.plate_entropy(px)):
        assert df.count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 150, 151, 30000])
def test_exact_medians(spark, n):
    rng = np.random.default_rng(n)
    w, h = rng.integers(0, 40, n) * 1.0, rng.lognormal(0, 2, n)
    rows = [(float(a), float(b) if i % 7 else None) for i, (a, b) in enumerate(zip(w, h, strict=True))]
    got = L.exact_medians(spark.createDataFrame(rows, "w double, h double"), ["w", "h"])
    some = [b for _, b in rows if b is not None]
    assert got == {"w": np.median(w), "h": np.median(some) if some else None}


def test_exact_medians_without_values(spark):
    assert L.exact_medians(spark.createDataFrame([(None,)], "w double"), ["w"]) == {"w": None}
    assert L.exact_medians(spark.createDataFrame([], "w double"), ["w"]) == {"w": None}
    assert L.exact_medians(spark.createDataFrame([(1,), (2,), (4,), (9,)], "w int"), ["w"]) == {"w": 3.0}


def test_sketch_bounds_that_miss_the_middle(spark, monkeypatch):
    """Bounds decide what is counted, not the result."""
    monkeypatch.setattr(L, "NEAR", (-0.4, -0.4, -0.4))
    assert L.exact_medians(spark.range(101).select(F.col("id").cast("double").alias("w")), ["w"]) == {"w": 50.0}


def test_stretch_bounds(spark):
    px = spark.createDataFrame([(1, 0, x, v) for x, v in enumerate([10, 20, 30, 40, 250])], "img_id int, y int, x int, v int")
    level = lambda b, w: [r.v for r in R.stretch_range(px, b, w).orderBy("x").collect()]
    assert level(0.2, 0.2) == [0, 0, 128, 255, 255]
    assert level(0.6, 0.6) == [0, 0, 0, 255, 255]
    assert level(10, 250) == [0, 11, 21, 32, 255]
