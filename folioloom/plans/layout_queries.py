"""Size statistics, votes and summaries over the driver's tables.

Parts stand for pages: size and price for width and height, and every third page isn't aligned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout as L
from .registry import query, table

PAGES = "select p_partkey as page_id, cast(p_size as double) as w, p_retailprice / 10 as h, p_partkey % 3 <> 0 as aligned from part"


def part_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("page_id"), F.col("p_size").cast("double").alias("w"), (F.col("p_retailprice") / 10).alias("h"), (F.col("p_partkey") % 3 != 0).alias("aligned"))


def _nan_docs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    value = F.when(F.col("doc_id") % 17 == 0, float("nan")).otherwise(F.col("n_chars").cast("double"))
    return d.select("doc_id", "lang", "source", value.alias("value"))


_DEV = """
with d as (select doc_id, lang, source, case when doc_id % 17 = 0 then 'nan'::double else cast(n_chars as double) end as value from documents),
s as (select {by} avg(value) filter (not isnan(value)) as mean, stddev_samp(value) filter (not isnan(value)) as sigma, count(*) as n from d {group})
select doc_id, {out} from d {join}
"""


@query(_DEV.format(by="lang, source,", group="group by lang, source", join="join s using (lang, source)", out="case when n < 3 then false when isnan(value) then false else abs(value - mean) > greatest(1.5 * coalesce(sigma, 'nan'::double), 20 / 100.0 * mean) end as is_deviant"))
def deviation_flags(spark, sf_dir):
    d = L.deviation(_nan_docs(spark, sf_dir), "value", ["lang", "source"])
    return d.select("doc_id", L.is_deviant(F.col("value"), F.col("stats"), 1.5, 20).alias("is_deviant"))


@query(_DEV.format(by="", group="", join=", s", out="round(case when n < 2 then 0.0 when isnan(value) then -1.0 else abs(value - mean) end, 6) as deviation"))
def deviation_value(spark, sf_dir):
    d = L.deviation(_nan_docs(spark, sf_dir), "value")
    return d.select("doc_id", F.round(L.deviation_value(F.col("value"), F.col("stats")), 6).alias("deviation"))


@query("""
select lang, count(*) as n, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as sigma from documents group by lang
""")
def deviation_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("v", F.col("n_chars").cast("double"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sigma"))


@query(f"select coalesce(max(w) filter (aligned), 0) as agg_w, coalesce(max(h) filter (aligned), 0) as agg_h from ({PAGES})")
def layout_aggregate_size(spark, sf_dir):
    return L.aggregate_size(part_pages(spark, sf_dir))


@query(f"""
with p as (select page_id, case when aligned then w else 0 end as w, case when aligned then h else 0 end as h, w as rw, h as rh from ({PAGES})),
t as (select *, row_number() over (order by w desc, page_id) as kw, row_number() over (order by h desc, page_id) as kh from p),
m as (select max(w) as w1, max(h) as h1, coalesce(max(w) filter (kw > 1), 0) as w2, coalesce(max(h) filter (kh > 1), 0) as h2 from t)
select page_id, case when kw = 1 then greatest(rw / 2, w2) else w1 end as agg_w, case when kh = 1 then greatest(rh / 2, h2) else h1 end as agg_h from t, m
""")
def layout_aggregate_whatif(spark, sf_dir):
    p = part_pages(spark, sf_dir)
    return L.aggregate_what_if(p, F.col("w") / 2, F.col("h") / 2).select("page_id", "agg_w", "agg_h")


@query(f"""
with p as ({PAGES}), a as (select max(w) as aw, max(h) as ah from p where aligned)
select page_id, round(greatest((aw - w) / aw, (ah - h) / ah), 6) as ratio from p, a where aligned and greatest((aw - w) / aw, (ah - h) / ah) >= 0.5
""")
def layout_soft_margin(spark, sf_dir):
    return L.excessive_soft_margins(part_pages(spark, sf_dir), 0.5).select("page_id", F.round("ratio", 6).alias("ratio"))


_ORDERS = "select l_orderkey as page_id, sum(l_quantity) as w, sum(round(l_extendedprice * 100)) / 100 as h, true as aligned from lineitem group by 1"


def order_pages(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sum("l_quantity").alias("w"), (F.sum(F.round(F.col("l_extendedprice") * 100)) / 100).alias("h"), F.lit(True).alias("aligned"))


@query(f"""
with p as ({_ORDERS}), m as (select quantile_cont(w, 0.5) as mw, quantile_cont(h, 0.5) as mh, max(w) as xw, max(h) as xh from p),
r as (select *, w * h / (mw * mh) as ratio from p, m)
select page_id, round(ratio, 6) as ratio, round(greatest(ratio, 1 / ratio), 6) as severity, abs(w - xw) < 0.01 as sets_w, abs(h - xh) < 0.01 as sets_h
from r where case when ratio > 1 then ratio >= 2 else ratio <= 1 / 2.0 end
""")
def layout_outliers(spark, sf_dir):
    out = L.outliers(order_pages(spark, sf_dir), 2.0)
    return out.select("page_id", F.round("ratio", 6).alias("ratio"), F.round("severity", 6).alias("severity"), "sets_w", "sets_h")


@query("""
with p as (select p_partkey as page_id, cast(p_size as double) as w, p_retailprice as h from part), m as (select median(w) as mw, max(w) as xw from p)
select page_id, round(w / xw, 6) as of_widest from p, m where xw / mw > 1.8 and xw / mw < 2.2 and w / xw > 0.9 and w / xw < 1.1
""")
def layout_unsplit_spreads(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_size").cast("double").alias("w"), F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("h"), F.lit(True).alias("aligned"))
    return L.unsplit_spreads(p).select("page_id", F.round("of_widest", 6).alias("of_widest"))


@query("""
with i as (select o_custkey as project, o_orderkey as image_id, o_orderstatus = 'F' as split from orders),
c as (select project, count(*) filter (split) as n_split, count(*) filter (not split) as n_single from i group by project)
select project, n_split, n_single, case when n_split > n_single then 'split' when n_split < n_single then 'single' else 'none' end as verdict,
  case when n_split = n_single then 0 else least(n_split, n_single) end as n_flipped from c
""")
def majority_vote(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("image_id"), (F.col("o_orderstatus") == "F").alias("split"))
    return L.majority_vote(o, ["project"])


_COVER = """
with r as (select l_orderkey, l_linenumber, l_quantity as w, l_discount * 100 as h, 50.0 as page_w, 10.0 as page_h, l_returnflag as mode from lineitem),
c as (select *, w * h / (page_w * page_h) as coverage from r where mode <> 'N')
"""


def _cover(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    rows = x.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("w"), (F.col("l_discount") * 100).alias("h"), F.lit(50.0).alias("page_w"), F.lit(10.0).alias("page_h"), F.when(F.col("l_returnflag") == "N", "disabled").otherwise("auto").alias("mode"))
    return L.coverage(rows)


@query(_COVER + "select l_orderkey, l_linenumber, round(coverage, 6) as coverage from c where coverage < 0.5")
def coverage_outliers(spark, sf_dir):
    return _cover(spark, sf_dir).filter("is_low").select("l_orderkey", "l_linenumber", F.round("coverage", 6).alias("coverage"))


@query(_COVER + "select cast(floor(coverage * 10) as int) as decile, count(*) as n, count(*) filter (coverage < 0.5) as n_low from c group by 1")
def coverage_summary(spark, sf_dir):
    c = _cover(spark, sf_dir)
    return c.groupBy(F.floor(F.col("coverage") * 10).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_low").alias("n_low"))


@query("""
with m as (select median(cast(p_size as double)) as m from part)
select p_partkey, round(abs(p_size - m) / m * 100, 6) as deviation, abs(p_size - m) / m * 100 > 10 as is_off from part, m
""")
def box_width_deviation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    return L.width_deviation(p).select("p_partkey", F.round("deviation", 6).alias("deviation"), "is_off")


@query("""
select o_orderstatus, count(distinct o_custkey) as n_images, count(distinct case when o_orderpriority like '1%' then o_custkey end) as n_split from orders group by 1
""")
def split_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n_images"), F.countDistinct(F.when(F.col("o_orderpriority").like("1%"), F.col("o_custkey"))).alias("n_split"))


@query(f"""
with p as ({PAGES}), a as (select max(w) as aw, max(h) as ah from p where aligned), g as (select page_id, aw - w as dw, ah - h as dh,
  case page_id % 4 when 0 then 'auto' when 1 then 'left' when 2 then 'center' else 'original' end as al, (page_id % 10) / 10.0 as c, aw, w from p, a where aligned),
n as (select *, greatest(0.0, least(c * aw - w / 2, dw)) as nearer from g),
r as (select *, case when al <> 'auto' then al when 3 * nearer < dw - nearer then 'left' when 3 * (dw - nearer) < nearer then 'right' else 'center' end as fin from n),
b as (select page_id, dw, case when dw <= 0 then 0.0 when fin = 'left' then 0.0 when fin = 'right' then dw when fin = 'center' then 0.5 * dw else nearer end as b from r)
select page_id, round(b, 6) as margin_left, round(case when dw <= 0 then 0.0 else dw - b end, 6) as margin_right from b
""")
def soft_margins(spark, sf_dir):
    p = part_pages(spark, sf_dir)
    rows = p.withColumn("_a", L.aggregate_size(p).select("agg_w").scalar()).filter("aligned")
    align = F.element_at(F.array(*map(F.lit, ("auto", "left", "center", "original"))), (F.col("page_id") % 4 + 1).cast("int"))
    left, right = L.soft_margins(F.col("_a") - F.col("w"), (F.col("page_id") % 10) / 10.0, F.col("_a"), F.col("w"), align, ("left", "right"))
    return rows.select("page_id", F.round(left, 6).alias("margin_left"), F.round(right, 6).alias("margin_right"))


@query("""
with r as (select p_partkey as page_id, cast(p_size + 100 as double) as pw, cast(p_size as double) as cw, cast(p_partkey % 60 as double) as cx, p_retailprice / 10 as mm from part),
s as (select *, cx as l, pw - cx - cw as r, pw * mm / cw - mm as slack_mm from r)
select page_id, round(case when l + r < 1 then 0 else l * slack_mm / (l + r) end, 6) as margin_left, round(case when l + r < 1 then 0 else r * slack_mm / (l + r) end, 6) as margin_right from s
""")
def auto_margins(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    rect = lambda x, w: F.struct(x.alias("x"), F.lit(0.0).alias("y"), w.alias("w"), F.lit(10.0).alias("h"))
    rows = p.select(F.col("p_partkey").alias("page_id"), rect(F.lit(0.0), size + 100).alias("page"), rect((F.col("p_partkey") % 60).cast("double"), size).alias("content"), (F.col("p_retailprice") / 10).alias("mm_w"), F.lit(10.0).alias("mm_h"))
    m = L.margins_mm("page", "content")
    return rows.select("page_id", F.round(m["left"], 6).alias("margin_left"), F.round(m["right"], 6).alias("margin_right"))


@query(f"""
with p as ({_ORDERS}), m as (select quantile_cont(w, 0.5) as mw, quantile_cont(h, 0.5) as mh, max(w) as xw, max(h) as xh from p)
select max(xw) as agg_w, max(xh) as agg_h, count(*) as n_pages, count(*) filter (w * h / (mw * mh) >= 1.3 or w * h / (mw * mh) <= 1 / 1.3) as n_outliers,
  count(*) filter (xw / mw > 1.8 and xw / mw < 2.2 and w / xw > 0.9 and w / xw < 1.1) as n_spreads from p, m
""")
def page_size_report(spark, sf_dir):
    p = order_pages(spark, sf_dir)
    out, wide = L.outliers(p, 1.3).agg(F.count(F.lit(1))).scalar(), L.unsplit_spreads(p).agg(F.count(F.lit(1))).scalar()
    n = p.agg(F.count(F.lit(1))).scalar()
    return L.aggregate_size(p).select("agg_w", "agg_h", n.alias("n_pages"), out.alias("n_outliers"), wide.alias("n_spreads"))


@query(f"""
with p as ({_ORDERS}), m as (select quantile_cont(w, 0.5) as mw, quantile_cont(h, 0.5) as mh from p)
select page_id, not (w * h / (mw * mh) >= 1.3 or w * h / (mw * mh) <= 1 / 1.3) as aligned from p, m
""")
def detach_outliers(spark, sf_dir):
    """Pages of an outlying size are no longer aligned with the others."""
    p = order_pages(spark, sf_dir)
    out = L.outliers(p, 1.3).select("page_id", F.lit(True).alias("_out"))
    return p.join(out, "page_id", "left").select("page_id", F.col("_out").isNull().alias("aligned"))
