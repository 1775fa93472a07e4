"""The page relation, orders, staleness and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import orders as O
from ..operators import pages as P
from ..operators import spans as S
from ..operators import staleness as T
from .registry import query, table


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return P.positions(c.select(F.col("conv_id").alias("project"), F.col("turn").alias("page_id"), "role"), ["page_id"], ["project"])


_TURNS = "select conv_id as project, turn as page_id, row_number() over (partition by conv_id order by turn) - 1 as pos from conversations"


@query("""
with i as (select o_orderkey as image_id, case when o_orderkey % 3 = 0 then 1 else 2 end as n, case when o_orderkey % 5 = 0 then 'left' end as removed from orders),
s as (select image_id, unnest(case when n = 1 then ['single'] when removed = 'left' then ['right'] else ['right', 'left'] end) as sub,
  unnest(case when n = 1 then [0] when removed = 'left' then [0] else [0, 1] end) as sub_pos from i)
select image_id, sub_pos, sub from s
""")
def page_explode(spark, sf_dir):
    i = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("n_pages"), F.when(F.col("o_orderkey") % 5 == 0, "left").alias("removed"))
    return P.logical_pages(i, right_to_left=True).select("image_id", "sub_pos", "sub")


@query(f"""
with p as ({_TURNS}), w as (select conv_id as project, turn + 1 as page_id from conversations)
select project, page_id, coalesce(pos, -1) as pos from w left join p using (project, page_id)
""")
def page_numbers(spark, sf_dir):
    p = _turns(spark, sf_dir)
    wanted = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project"), (F.col("turn") + 1).alias("page_id"))
    return P.page_numbers(wanted, p, ["project"])


def _base(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("turn = 1 and conv_id % 4 <> 0").select(F.col("conv_id").alias("project"), F.col("turn").alias("page_id"))


_WITH_BASE = f"with p as ({_TURNS}), b as (select project, min(pos) as base from p where page_id = 1 and project % 4 <> 0 group by project)"


@query(_WITH_BASE + "select project, page_id, pos from p join b using (project) where pos >= base")
def select_followers(spark, sf_dir):
    return P.followers(_turns(spark, sf_dir), _base(spark, sf_dir), ["project"]).select("project", "page_id", "pos")


@query(_WITH_BASE + "select project, page_id, pos from p join b using (project) where (pos - base) % 2 = 0")
def select_every_other(spark, sf_dir):
    return P.every_other(_turns(spark, sf_dir), _base(spark, sf_dir), ["project"]).select("project", "page_id", "pos")


@query(_WITH_BASE + """, s as (select project, page_id, pos, pos - row_number() over (partition by project order by pos) as run from p where pos % 5 <> 4),
h as (select s.project, s.run, s.pos as origin from s join b on b.project = s.project and b.base = s.pos) select s.project, s.page_id, s.pos from s join h using (project, run) where (s.pos - origin) % 2 = 0""")
def select_every_other_in_range(spark, sf_dir):
    return P.every_other_in_range(_turns(spark, sf_dir).filter("pos % 5 <> 4"), _base(spark, sf_dir), ["project"]).select("project", "page_id", "pos")


@query("""
with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events),
s as (select user_id, pos, pos - row_number() over (partition by user_id order by pos) as g from e where event_type <> 'view')
select user_id, min(pos) as first, max(pos) as last, count(*) as n from s group by user_id, g
""")
def select_ranges(spark, sf_dir):
    e = P.positions(table(spark, sf_dir, "events"), ["ts", "event_id"], ["user_id"])
    return P.ranges(e.filter("event_type <> 'view'").select("user_id", "pos"), ["user_id"])


@query("select event_type, count(*) as n from events where event_type in ('view', 'click') group by 1")
def color_mode_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "view", "bw").when(F.col("event_type") == "click", "mixed").otherwise("color")
    return e.filter(P.color_filter(mode, {"bw": True, "mixed": True})).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _scans(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 100).alias("w"), (F.col("p_retailprice") * 2).cast("int").alias("h"), (F.col("p_partkey") % 40 * 15).cast("int").alias("dpi_x"), (F.col("p_partkey") % 700 * 16).cast("int").alias("dpi_y"), (F.col("p_partkey") % 4 * 90).cast("int").alias("rotation"))


_SCANS = "select p_partkey as image_id, p_size * 100 as w, cast(trunc(p_retailprice * 2) as int) as h, cast(p_partkey % 40 * 15 as int) as dpi_x, cast(p_partkey % 700 * 16 as int) as dpi_y, cast(p_partkey % 4 * 90 as int) as rotation from part"
_DPI = """case when dpi_x <= 1 or dpi_y <= 1 then 'undefined' when dpi_x < 150 or dpi_y < 150 then 'too_small' when dpi_x > 9999 or dpi_y > 9999 then 'too_large'
 when w * 25.4 / dpi_x > 500 or h * 25.4 / dpi_y > 500 then 'too_small_for_pixels' else 'ok' end"""


@query(f"select image_id, {_DPI} as status from ({_SCANS})")
def dpi_status(spark, sf_dir):
    return _scans(spark, sf_dir).select("image_id", P.dpi_status(*map(F.col, ("w", "h", "dpi_x", "dpi_y"))).alias("status"))


@query(f"select coalesce(bool_and({_DPI} = 'ok'), true) as all_ok from ({_SCANS})")
def all_dpi_ok(spark, sf_dir):
    return P.all_dpi_ok(_scans(spark, sf_dir))


@query(f"select image_id, case when (case when rotation % 180 = 90 then cast(h as bigint) * dpi_x > cast(w as bigint) * dpi_y else cast(w as bigint) * dpi_y > cast(h as bigint) * dpi_x end) then 2 else 1 end as n_pages from ({_SCANS})")
def advised_pages(spark, sf_dir):
    s = _scans(spark, sf_dir)
    big = [F.col(c).cast("long") for c in ("w", "h", "dpi_x", "dpi_y")]
    return s.select("image_id", P.advised_pages(*big, F.col("rotation")).alias("n_pages"))


@query(f"""
select image_id, round(w * 25.4 / greatest(dpi_x, 100), 6) as w_mm, round(h / greatest(dpi_y, 100)::double, 6) as h_in, case when rotation % 180 = 90 then h else w end as rw,
 case rotation when 90 then h - 20 when 180 then w - 10 when 270 then 20 else 10 end as px, case rotation when 90 then 10 when 180 then h - 20 when 270 then w - 10 else 20 end as py from ({_SCANS})
""")
def units_and_rotation(spark, sf_dir):
    s, at = _scans(spark, sf_dir), [F.col(c) for c in ("w", "h", "rotation")]
    px, py = P.rotate_point(F.lit(10), F.lit(20), *at)
    mm = P.convert_units(F.col("w"), F.greatest("dpi_x", F.lit(100)), "px", "mm")
    inches = P.convert_units(F.col("h"), F.greatest("dpi_y", F.lit(100)), "px", "in")
    return s.select("image_id", F.round(mm, 6).alias("w_mm"), F.round(inches, 6).alias("h_in"), P.rotate_size(*at)[0].alias("rw"), px.alias("px"), py.alias("py"))


@query(f"""
with s as (select image_id, cast(w as double) as w, cast(h as double) as h, cast(rotation as double) as r from ({_SCANS}))
select image_id, round((cos(radians(r)) * (w - 5) - sin(radians(r)) * (h - 7)) * 0.5, 4) as x, round((sin(radians(r)) * (w - 5) + cos(radians(r)) * (h - 7)) * 2, 4) as y from s
""")
def affine_chain(spark, sf_dir):
    s = _scans(spark, sf_dir)
    crop, scale = P.crop_and_scale(F.lit(5.0), F.lit(7.0), F.lit(0.5), F.lit(2.0))
    m = P.affine(crop, P.rotation_matrix(F.col("rotation").cast("double")), scale)
    x, y = P.apply_affine(m, F.col("w").cast("double"), F.col("h").cast("double"))
    return s.select("image_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and doc_id <> 7")
def missing_params(spark, sf_dir):
    return P.missing_params(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", F.col("doc_id") == 7)


@query("select doc_id, quality from labels l where exists (select 1 from documents d where d.doc_id = l.doc_id and d.lang = 'en')")
def orphan_params(spark, sf_dir):
    return P.drop_orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id").select("doc_id", "quality")


@query("""
with p as (select l_orderkey as image_id, case l_linenumber when 1 then 'left' else 'right' end as sub, l_returnflag from lineitem where l_linenumber <= 2),
k as (select image_id, sub from p where not exists (select 1 from p q where q.image_id = p.image_id and q.sub = p.sub and q.l_returnflag = 'R'))
select image_id, cast(count(*) as int) as n_left, list_sort(list_distinct(list(sub))) as subs from k group by image_id
""")
def remove_pages(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    p = x.select(F.col("l_orderkey").alias("image_id"), F.when(F.col("l_linenumber") == 1, "left").otherwise("right").alias("sub"), "l_returnflag")
    return P.remove_pages(p.select("image_id", "sub"), p.filter("l_returnflag = 'R'").select("image_id", "sub"))


@query("""
with i as (select o_orderkey as image_id, 2 as n_pages, case o_orderkey % 3 when 0 then 'left' when 1 then 'right' end as removed from orders)
select image_id, n_pages, case when removed = 'left' and image_id % 2 = 0 then null else removed end as removed from i
""")
def unremove_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(2).alias("n_pages"), F.when(F.col("o_orderkey") % 3 == 0, "left").when(F.col("o_orderkey") % 3 == 1, "right").alias("removed"))
    return P.unremove_half(o, o.filter("image_id % 2 = 0").select("image_id", F.lit("left").alias("sub")))


@query(f"""
with p as ({_TURNS}), a as (select project, page_id as image_id, pos, 0 as side, 0 as seq from p
  union all select project, page_id + 1000, pos, case when page_id % 2 = 0 then -1 else 1 end, page_id from p where page_id <= 1)
select project, image_id, row_number() over (partition by project order by pos, side, seq) - 1 as pos from a
""")
def insert_images(spark, sf_dir):
    p = _turns(spark, sf_dir).withColumnRenamed("page_id", "image_id")
    new = p.filter("image_id <= 1").select("project", (F.col("image_id") + 1000).alias("image_id"), F.col("image_id").alias("at_id"), F.when(F.col("image_id") % 2 == 0, "before").otherwise("after").alias("side"), F.col("image_id").alias("seq"))
    return P.insert_images(p, new, ["project"])


@query("select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic from documents d left join labels l using (doc_id)")
def upsert_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return P.upsert(d, table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])


@query("select page_id, case when starts_with(url, 'https://www.') then 'file:///scans/' || substr(url, 13) else url end as url from pages")
def relink_paths(spark, sf_dir):
    return P.relink(table(spark, sf_dir, "pages").select("page_id", "url"), "https://www.", "file:///scans/", "url")


@query(r"""
with p as (select page_id, replace(replace(url, '/', '//'), ':', '\') || case when page_id % 3 = 0 then '/./x/../../y/' when page_id % 3 = 1 then '/./x/' else '/z/../w/..' end as raw from pages),
c as (select page_id, list_filter(string_split(replace(raw, '\', '/'), '/'), lambda x: x not in ('', '.')) as parts from p)
select page_id, array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda done, x: case when x[1] = '..' then done[:-2] else done || x end), '/') as path from c
union all select -1, null union all select -2, '/a' union all select -3, ''
""")
def normalize_paths(spark, sf_dir):
    raw = F.concat(F.replace(F.replace("url", F.lit("/"), F.lit("//")), F.lit(":"), F.lit("\\")), F.when(F.col("page_id") % 3 == 0, "/./x/../../y/").when(F.col("page_id") % 3 == 1, "/./x/").otherwise("/z/../w/.."))
    more = spark.createDataFrame([(-1, "c:/../x"), (-2, "/a/b/.."), (-3, "/")], "page_id long, raw string")
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw")).unionByName(more).select("page_id", P.normalize_path(F.col("raw")).alias("path"))


@query("select p_partkey, p_name, row_number() over (partition by split_part(p_name, ' ', 1) order by p_partkey) - 1 as label from part")
def file_label(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("base", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return P.disambiguate(p, "base", ["p_partkey"]).select("p_partkey", "p_name", "label")


_NAMES = """
select doc_id, source || case when doc_id % 3 > 0 then '(' || doc_id % 3 || ')' else '' end || case when doc_id % 50 > 0 then '_page' || lpad(cast(doc_id % 50 as varchar), 4, '0') else '' end
 || case doc_id % 4 when 0 then '_1L' when 1 then '_2R' else '' end as base from documents
"""


def _names(spark, sf_dir, ext=""):
    d = table(spark, sf_dir, "documents")
    sub = F.when(F.col("doc_id") % 4 == 0, "left").when(F.col("doc_id") % 4 == 1, "right").otherwise("single")
    return d.select("doc_id", P.output_name(F.col("source"), F.col("doc_id") % 3, F.col("doc_id") % 50, sub, ext).alias("base"))


@query(f"select doc_id, base || '.tif' as name from ({_NAMES})")
def output_file_name(spark, sf_dir):
    return _names(spark, sf_dir, ".tif").withColumnRenamed("base", "name")


@query(f"""
with n as ({_NAMES}), f as (select base, base || unnest(case when doc_id % 2 = 0 then ['.png', '.jpg'] else ['.jpg', '.gif'] end) as name from n where doc_id % 5 <> 0),
b as (select base, min_by(name, case right(name, 4) when '.tif' then 1 when '.png' then 2 else 3 end) as found from f where right(name, 4) in ('.tif', '.png', '.jpg') group by base)
select doc_id, n.base, found from n left join b on n.base = b.base
""")
def existing_output_file(spark, sf_dir):
    n = _names(spark, sf_dir)
    exts = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(".png"), F.lit(".jpg"))).otherwise(F.array(F.lit(".jpg"), F.lit(".gif")))
    files = n.filter("doc_id % 5 <> 0").select(F.col("base"), F.explode(exts).alias("e")).select(F.concat("base", "e").alias("name"))
    return P.existing_output(n, files)


@query("""
select doc_id, case when lang in ('en', 'de') then 'gray' else lang end as never_color, 'bw' as force_bw, case when doc_id % 2 = 0 then lang end as manual from documents
""")
def color_policy(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    mode = F.when(F.col("lang") == "en", "color").when(F.col("lang") == "de", "mixed").otherwise(F.col("lang"))
    kept = P.clear_automatic(d.select("doc_id", F.col("lang").alias("mode"), (F.col("doc_id") % 2 == 1).alias("automatic"), mode.alias("m")))
    return kept.select("doc_id", P.color_policy(F.col("m"), "never_color").alias("never_color"), P.color_policy(F.col("m"), "force_bw").alias("force_bw"), F.col("mode").alias("manual"))


_NATURAL = r"""
select {key}, row_number() over ({by} order by list_transform(regexp_extract_all({name}, '(\d+|\D)'), lambda t: case when regexp_matches(t, '^\d') then [0, t::hugeint] else [1, 0] end), {name}, {key}) - 1 as pos from {table}
"""


@query(_NATURAL.format(key="s_suppkey", name="replace(s_name, '#0', '#' || s_suppkey % 3)", by="partition by s_nationkey", table="supplier"))
def natural_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("name", F.replace("s_name", F.lit("#0"), F.concat(F.lit("#"), (F.col("s_suppkey") % 3).cast("string"))))
    return O.ranked(s, [*O.natural_order("name"), F.col("s_suppkey")], ["s_nationkey"]).select("s_suppkey", "pos")


_RANK = "select o_orderkey, row_number() over (partition by o_custkey order by {order}) - 1 as pos from orders"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumns({"incomplete": F.col("o_orderstatus") == "O", "layout": F.when(F.col("o_orderkey") % 3 == 0, "auto").when(F.col("o_orderkey") % 3 == 1, "two_pages").otherwise("single_uncut")})


@query(_RANK.format(order="(o_orderstatus = 'O') desc, o_totalprice desc, o_orderkey"))
def order_by_deviation(spark, sf_dir):
    return O.ranked(_orders(spark, sf_dir), O.by_deviation("o_totalprice", "incomplete", "o_orderkey"), ["o_custkey"]).select("o_orderkey", "pos")


@query(_RANK.format(order="o_orderstatus = 'O', o_orderkey"))
def order_by_completeness(spark, sf_dir):
    return O.ranked(_orders(spark, sf_dir), O.by_completeness("incomplete", "o_orderkey"), ["o_custkey"]).select("o_orderkey", "pos")


@query(_RANK.format(order="case o_orderkey % 3 when 0 then 100 when 1 then 3 else 1 end, o_orderkey"))
def order_by_split_type(spark, sf_dir):
    return O.ranked(_orders(spark, sf_dir), O.by_split_type("layout", "o_orderkey"), ["o_custkey"]).select("o_orderkey", "pos")


@query(_RANK.format(order="case when o_orderstatus <> 'O' then o_totalprice end asc nulls last, o_orderkey"))
def order_by_width(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("w", F.when(~F.col("incomplete"), F.col("o_totalprice")))
    return O.ranked(o, O.by_size("w", "o_orderkey"), ["o_custkey"]).select("o_orderkey", "pos")


@query("select o_orderkey, row_number() over (partition by o_custkey order by case when o_orderstatus <> 'O' then o_totalprice end desc nulls first, o_orderkey desc) - 1 as pos from orders")
def order_reversed(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("w", F.when(~F.col("incomplete"), F.col("o_totalprice")))
    return O.reversed_order(o, O.by_size("w", "o_orderkey"), ["o_custkey"]).select("o_orderkey", "pos")


@query("""
select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by 's' || l_suppkey % 3, l_partkey % 4, l_linenumber % 3, l_linenumber) - 1 as pos from lineitem
""")
def order_by_page_id(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumns({"path": F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")), "page": F.col("l_partkey") % 4, "sub": F.element_at(F.array(*map(F.lit, O.SUBS)), F.col("l_linenumber") % 3 + 1)})
    return O.ranked(x, [*O.by_page_id(), F.col("l_linenumber")], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "pos")


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by 's' || l_suppkey % 3, l_partkey % 4, l_linenumber) - 1 as pos from lineitem")
def order_by_image_id(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumns({"path": F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")), "page": F.col("l_partkey") % 4})
    return O.ranked(x, [*O.by_image_id(), F.col("l_linenumber")], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "pos")


@query("select o_custkey, o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def top_pages(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["o_custkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("select d.doc_id, coalesce(l.quality, 1) as quality, l.doc_id is not null as is_set from documents d left join labels l using (doc_id)")
def stage_params(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("is_set"))
    return T.with_params(table(spark, sf_dir, "documents").select("doc_id"), l, ["doc_id"], {"quality": 1, "is_set": False})


@query("select d.doc_id, l.toxic as box, l.toxic is not null as is_valid from documents d left join labels l using (doc_id)")
def propagate_boxes(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("box"))
    return T.propagate(table(spark, sf_dir, "documents").select("doc_id", F.lit(9).alias("box")), l, ["doc_id"], "box")


@query("select o_orderkey as image_id, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 'two_pages' else o_orderstatus end as layout from orders")
def force_layout(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("layout"))
    x = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"))
    return T.force_layout(o, x, "two_pages").select("image_id", "layout")


@query("""
with s as (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderstatus end as a, case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end as b from orders where o_orderkey % 13 <> 0),
c as (select o_orderkey, case when o_orderkey % 14 = 0 then null else o_orderstatus end as a, o_totalprice as b from orders)
select c.o_orderkey, s.o_orderkey is null or s.a is distinct from c.a or s.b is distinct from c.b as is_stale from c left join s using (o_orderkey)
""")
def cache_stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    old = o.filter(key % 13 != 0).select(key, F.when(key % 7 != 0, F.col("o_orderstatus")).alias("a"), F.when(key % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("b"))
    return T.stale(old, o.select(key, F.when(key % 14 != 0, F.col("o_orderstatus")).alias("a"), F.col("o_totalprice").alias("b")), ["o_orderkey"], ["a", "b"])


@query("select p_partkey, p_partkey % 5 <> 0 and (p_partkey % 3 <> 0 or p_partkey % 4 in (0, 3)) as is_compatible from part")
def split_dependencies(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    dep = lambda rot, version: F.struct(rot.alias("rotation"), F.col("p_size").alias("w"), F.col("p_size").alias("h"), F.lit("two").alias("layout_type"), version.cast("int").alias("detector_version"))
    version = F.when(key % 4 == 0, F.lit(None)).otherwise(key % 4)
    old, new = dep(F.when(key % 5 == 0, 90).otherwise(0), version), dep(F.lit(0), F.lit(3))
    mode = F.when(key % 3 == 0, "auto").otherwise("manual")
    return p.select("p_partkey", T.split_compatible(old, new, mode).alias("is_compatible"))


@query("""
select p_partkey, (p_partkey % 4 = p_partkey % 2) and (p_partkey % 10) / 10.0 <= 0.5 as is_same, p_partkey % 3 = 0 and p_size > 25 as update_content, p_size > 25 as update_size from part
""")
def stage_dependencies(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    pt = lambda x: F.struct(x.cast("double").alias("x"), F.lit(1.0).alias("y"))
    dep = lambda rot, x: F.struct(rot.alias("rotation"), F.array(pt(F.lit(0)), pt(x)).alias("outline"))
    same = T.deskew_matches(dep(key % 4, F.lit(0)), dep(key % 2, (key % 10) / 10.0))
    needs = T.content_needs(F.when(F.col("p_size") <= 25, F.lit(1)), F.lit(1), F.when(key % 3 == 0, "auto").otherwise("manual"))
    return p.select("p_partkey", same.alias("is_same"), *[c.alias(k) for k, c in needs.items()])


@query("""
with a as (select c_custkey as k, case when c_custkey % 3 = 0 then '' else c_name end as title, c_mktsegment as publisher from customer where c_custkey % 2 = 0),
b as (select s_suppkey as k, s_name as title, cast(null as varchar) as publisher from supplier)
select coalesce(a.k, b.k) as k, coalesce(nullif(a.title, ''), b.title) as title, coalesce(nullif(a.publisher, ''), b.publisher) as publisher from a full join b on a.k = b.k
""")
def metadata_merge(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("publisher"))
    b = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("publisher"))
    return T.merge_records(a, b, ["k"], ["title", "publisher"])


_RECTS = "select l_suppkey as s, {id} as id, cast(l_quantity * 4 as int) as x0, cast(l_partkey % 97 as int) as y0, cast(l_quantity * 4 as int) + {w} as x1, cast(l_partkey % 97 as int) + {h} as y1 from lineitem where {where}"


@query(f"""
with a as ({_RECTS.format(id="l_orderkey * 10 + l_linenumber", w=40, h=30, where="l_returnflag = 'R'")}), b as ({_RECTS.format(id="l_orderkey * 10 + l_linenumber", w=25, h=50, where="l_returnflag = 'A'")}),
j as (select a.s, a.id as a_id, b.id as b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as shared from a join b on a.s = b.s)
select s, a_id, b_id, round(shared / 1200.0, 6) as overlap from j where shared / 1200.0 >= 0.5
""")
def frame_overlaps(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_quantity") * 4).cast("int"), (F.col("l_partkey") % 97).cast("int")
    rects = lambda flag, w, h: x.filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"))
    return T.overlaps(rects("R", 40, 30), rects("A", 25, 50), ["s"], 0.5).withColumn("overlap", F.round("overlap", 6))


@query("""
with a as (select conv_id, list(role order by turn) as z from conversations where conv_id % 5 <> 0 group by conv_id), b as (select conv_id, list(case when conv_id % 3 = 0 and turn = 1 then 'x' else role end order by turn) as z from conversations where conv_id % 7 <> 0 group by conv_id)
select coalesce(a.conv_id, b.conv_id) as conv_id, a.z is not distinct from b.z as is_equal from a full join b on a.conv_id = b.conv_id
""")
def zones_equal(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("zone"))
    b = c.withColumn("zone", F.when((F.col("conv_id") % 3 == 0) & (F.col("seq") == 1), "x").otherwise(F.col("zone")))
    return T.zones_equal(c.filter("conv_id % 5 <> 0"), b.filter("conv_id % 7 <> 0"), ["conv_id"], "zone")


_PROFILE = "select user_id, cast(date_diff('hour', timestamp '1990-01-01', ts) as int) as i, count(*) as n from events group by all"


def _profile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hour = F.expr("cast(timestampdiff(HOUR, timestamp_ntz '1990-01-01 00:00:00', ts) as int)")
    return e.groupBy("user_id", hour.alias("i")).agg(F.count(F.lit(1)).alias("n"))


_SPANS = f"""
with p as ({_PROFILE}), g as (select *, case when i - lag(i) over (partition by user_id order by i) - 1 >= 24 or lag(i) over (partition by user_id order by i) is null then 1 else 0 end as new from p),
k as (select *, sum(new) over (partition by user_id order by i) as k from g), s as (select user_id, min(i) as b, max(i) + 1 as e from k group by user_id, k having max(i) + 1 - min(i) >= 2)
"""


@query(_SPANS + "select user_id, b, e from s")
def content_spans(spark, sf_dir):
    return S.content_spans(_profile(spark, sf_dir), ["user_id"], 2, 24)


@query(_SPANS + ", r as (select *, row_number() over (partition by user_id order by e - b desc, b) as r from s) select user_id, b, e from r where r = 1")
def longest_span(spark, sf_dir):
    s = S.content_spans(_profile(spark, sf_dir), ["user_id"], 2, 24)
    runs = s.select("user_id", F.explode(F.sequence("b", F.col("e") - 1)).alias("i")).withColumn("flag", F.lit(True))
    return S.longest_run(runs, ["user_id"])


@query("""
with p as (select o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) as double) as x, o_totalprice / 1000 as y from orders),
d as (select *, x - lag(x) over (partition by o_custkey order by x) as dx, y - lag(y) over (partition by o_custkey order by x) as dy from p)
select o_custkey, x, round(sum(coalesce(sqrt(dx * dx + dy * dy), 0)) over (partition by o_custkey order by x), 5) as length from d
""")
def arc_length(spark, sf_dir):
    o = P.positions(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_custkey"])
    pts = o.select("o_custkey", (F.col("pos") + 1).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return S.arc_length(pts, ["o_custkey"]).select("o_custkey", "x", F.round("length", 5).alias("length"))


@query("""
with p as (select o_custkey, cast(o_orderkey % 97 as double) as x, o_totalprice as y from orders), s as (select o_custkey, count(*) as n, sum(x) as sx, sum(x * x) as sxx, sum(y) as sy, sum(x * y) as sxy from p group by 1)
select o_custkey, round(case when n * sxx = sx * sx then 0 else (n * sxy - sx * sy) / (n * sxx - sx * sx) end, 3) as slope from s
""")
def line_fit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 97).cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return S.line_fit(o, ["o_custkey"]).select("o_custkey", F.round("slope", 3).alias("slope"))


@query("""
with p as (select l_partkey as page_id, max(l_tax) as tax, max(l_orderkey) as deps from lineitem group by l_partkey), z as (select p_partkey as page_id from part where p_size > 25)
select page_id, 0.0::double as angle, 'manual' as mode, null::bigint as deps from z
union all select page_id, cast(tax as double), 'auto', deps from p where page_id not in (select page_id from z)
""")
def deskew_zero(spark, sf_dir):
    params = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("page_id")).agg(F.max("l_tax").cast("double").alias("angle"), F.lit("auto").alias("mode"), F.max("l_orderkey").cast("long").alias("deps"))
    return T.deskew_zero(params, table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("page_id")))
