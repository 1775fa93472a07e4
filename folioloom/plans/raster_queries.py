"""Raster operators over the embeddings table, whose vectors are 8 x 8 gray rasters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import raster as R
from ..operators import spans as S
from .registry import query, table

PX = """px as (select img_id, (i // 8)::int as y, (i % 8)::int as x, least(255, greatest(0, cast(floor((cast(e as double) + 1) * 128) as int))) as v
  from (select vec_id as img_id, unnest(embedding) as e, unnest(range(64)) as i from embeddings)),
bits as (select img_id, y, x, (v < 128)::int as b from px)"""
WITH = f"with {PX} "


def px(spark, sf_dir):
    return R.from_embeddings(table(spark, sf_dir, "embeddings"))


def bits(spark, sf_dir):
    return px(spark, sf_dir).select("img_id", "y", "x", (F.col("v") < 128).cast("int").alias("b"))


@query(WITH + "select i.img_id, t.bin::int as bin, coalesce(n, 0) as n from (select distinct img_id from px) i cross join range(256) t(bin) left join (select img_id, v, count(*) as n from px group by all) h on h.img_id = i.img_id and h.v = t.bin")
def hist256(spark, sf_dir):
    return R.histogram(px(spark, sf_dir))


@query(WITH + "select img_id, 'row' as axis, y as i, cast(sum(b) as bigint) as n from bits group by all union all select img_id, 'column', x, cast(sum(b) as bigint) from bits group by all")
def sliced_hist(spark, sf_dir):
    return R.sliced_histogram(bits(spark, sf_dir))


OTSU = """h as (select img_id, v as bin, count(*) as n from px group by all),
c as (select img_id, bin, sum(n) over w as below, sum(n * bin) over w as sb, sum(n) over (partition by img_id) as total, sum(n * bin) over (partition by img_id) as sa, lead(bin) over w as nb from h window w as (partition by img_id order by bin)),
d as (select *, cast(sb as double) / below - cast(sa - sb as double) / (total - below) as diff from c where total > below),
e as (select *, diff * diff * below * (total - below) as score, max(diff * diff * below * (total - below)) over (partition by img_id) as best from d),
o as (select img_id, cast((min(bin) + 1 + max(nb)) // 2 as int) as threshold from e where score = best group by img_id)"""


@query(f"with {PX}, {OTSU} select i.img_id, coalesce(threshold, 0) as threshold from (select distinct img_id from px) i left join o on i.img_id = o.img_id")
def otsu_threshold(spark, sf_dir):
    return R.otsu(px(spark, sf_dir))


@query(f"with {PX}, {OTSU} select px.img_id, y, x, (v < threshold)::int as b from px join o using (img_id)")
def binarize_otsu(spark, sf_dir):
    p = px(spark, sf_dir)
    return R.binarize(p, R.otsu(p))


@query(WITH + "select img_id, count(*) filter (b = 1) as n, min(x) filter (b = 1) as x0, max(x) filter (b = 1) as x1, min(y) filter (b = 1) as y0, max(y) filter (b = 1) as y1 from bits group by img_id")
def black_box(spark, sf_dir):
    return R.bounding_box(bits(spark, sf_dir))


@query(WITH + "select img_id, min(v) as darkest, max(v) as lightest, round(avg(v), 6) as mean from px group by img_id")
def gray_levels(spark, sf_dir):
    return px(spark, sf_dir).groupBy("img_id").agg(F.min("v").alias("darkest"), F.max("v").alias("lightest"), F.round(F.avg("v"), 6).alias("mean"))


INTEGRAL = "s1 as (select img_id, y, x, sum(v) over (partition by img_id, y order by x) as s from px), s2 as (select img_id, y, x, cast(sum(s) over (partition by img_id, x order by y) as bigint) as s from s1)"


@query(f"with {PX}, {INTEGRAL} select * from s2")
def integral_image(spark, sf_dir):
    return R.integral(px(spark, sf_dir))


@query(WITH + "select img_id, cast(sum(v) as bigint) as s from px where y >= 2 and y < 7 and x >= 1 and x < 5 group by img_id")
def integral_sum(spark, sf_dir):
    return R.box_sum(R.integral(px(spark, sf_dir)), 2, 1, 7, 5)


def _two_pass(agg: str, size: int, src: str, out: str, column: str = "v") -> str:
    a, b = size // 2, size - size // 2 - 1
    return f"""{out}_r as (select img_id, y, x, {agg}({column}) over (partition by img_id, y order by x rows between {a} preceding and {b} following) as {column} from {src}),
{out} as (select img_id, y, x, {agg}({column}) over (partition by img_id, x order by y rows between {a} preceding and {b} following) as {column} from {out}_r)"""


def _morph(name: str, steps: list[str], f) -> None:
    chain, src = [PX], "px"
    for i, s in enumerate(steps):
        chain.append(_two_pass(s, 3, src, f"m{i}"))
        src = f"m{i}"
    query(f"with {', '.join(chain)} select img_id, y, x, v from {src}", name)(lambda spark, sf_dir: f(px(spark, sf_dir)).select("img_id", "y", "x", "v"))


_morph("dilate_gray", ["min"], R.dilate)
_morph("erode_gray", ["max"], R.erode)
_morph("open_gray", ["max", "min"], R.opened)
_morph("close_gray", ["min", "max"], R.closed)
_morph("rolling_max_wide", ["max", "max"], lambda p: R.erode(R.erode(p)))


@query(f"""with {PX}, {_two_pass("min", 3, "bits", "e", "b")}, {_two_pass("max", 3, "e", "o", "b")}, {_two_pass("max", 3, "bits", "d", "b")}, {_two_pass("min", 3, "d", "c", "b")}
select bits.img_id, bits.y, bits.x, bits.b - o.b as white_hat, c.b - bits.b as black_hat from bits join o using (img_id, y, x) join c using (img_id, y, x)""")
def top_hats(spark, sf_dir):
    return R.top_hats(bits(spark, sf_dir))


@query(f"""with {PX}, {_two_pass("max", 3, "px", "e")}, {_two_pass("min", 3, "px", "d")}
select px.img_id, px.y, px.x, e.v - px.v as dark_side, px.v - d.v as light_side from px join e using (img_id, y, x) join d using (img_id, y, x)""")
def morph_gradient(spark, sf_dir):
    return R.morph_gradient(px(spark, sf_dir))


STATS = """st as (select a.img_id, a.y, a.x, any_value(a.v)::double as v, cast(sum(b.v) as double) / count(*) as m,
  sqrt(abs(cast(sum(b.v * b.v) as double) / count(*) - (cast(sum(b.v) as double) / count(*)) * (cast(sum(b.v) as double) / count(*)))) as s, max(b.v) as lm
  from px a join px b on a.img_id = b.img_id and b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 group by a.img_id, a.y, a.x),
g as (select img_id, min(v) as gmin, max(s) as smax, min(s) as smin, avg(v) as gm, max(abs((v - m) / (256 - (v - m)))) as fmax from st group by img_id),
t as (select * from st join g using (img_id))"""
RULES = {
    "niblack": ("v < m - 0.2 * (s - 1)", {"k": 0.2, "delta": 1.0}),
    "sauvola": ("v < m * (1 + 0.34 * ((s + 2) / 128 - 1))", {"delta": 2.0}),
    "bradley": ("v < m * (1 - 0.05)", {"k": 0.05}),
    "nick": ("v < m - 0.1 * sqrt(s * s + (50 - 10) * 0.01 * m * m)", {"k": 0.1, "delta": 10.0}),
    "wolf": ("v < 1 or (v <= 254 and coalesce(v < m - 0.3 * (1 - (s / smax + 0.0 / 128)) * (m - gmin), false))", {"k": 0.3}),
    "wan": ("v < (m + lm) / 2 * (1 - 0.2 * (1 - (s + 0) / 128))", {"k": 0.2}),
    "singh": ("v < m * (1 - 0.5 * 0.2 * (1 - (abs(v - m) / (256 - abs(v - m) + 1e-6) + 8 / 128)))", {"k": 0.2, "delta": 8.0}),
    "fox": ("v < least(255.0, greatest(0.0, (m - gmin) * (1 - 0.5 * 0.3 * (1 - (case when fmax > 0 then (v - m) / (256 - (v - m)) / fmax else 1 end + 16 / 128))) + gmin))", {"k": 0.3, "delta": 16.0}),
    "window": ("v < m * (1 - 0.2 * ((m + 1) / (gm + s + 1)) / (1 + (2 * gm + 1) / (s + 1) * case when smax = smin then 1 else (s - smin) / (smax - smin) end))", {"k": 0.2}),
}
for _name, (_rule, _args) in RULES.items():
    query(f"with {PX}, {STATS} select img_id, y, x, ({_rule})::int as b from t", f"local_threshold_{_name}")(
        lambda spark, sf_dir, method=_name, args=_args: R.local_threshold(px(spark, sf_dir), method, 5, 5, **args))


@query(f"""with {PX}, k as (select img_id, y, x, unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) as oy, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) as ox from px)
select k.img_id, k.y, k.x, cast(sum(p.v * ox * (2 - abs(oy))) as bigint) as gx, cast(sum(p.v * oy * (2 - abs(ox))) as bigint) as gy from k
join px p on p.img_id = k.img_id and p.y = least(7, greatest(0, k.y + oy)) and p.x = least(7, greatest(0, k.x + ox)) group by all""")
def sobel(spark, sf_dir):
    return R.sobel(px(spark, sf_dir)).withColumns({"gx": F.col("gx").cast("long"), "gy": F.col("gy").cast("long")})


@query(WITH + """, st as (select a.img_id, a.y, a.x, any_value(a.v) as v, cast(sum(b.v) as double) / count(*) as m, sqrt(abs(cast(sum(b.v * b.v) as double) / count(*) - (cast(sum(b.v) as double) / count(*)) * (cast(sum(b.v) as double) / count(*)))) as s
  from px a join px b on a.img_id = b.img_id and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by a.img_id, a.y, a.x)
select img_id, y, x, cast(floor(greatest(0, least(255, case when s * s > 1e-6 then m + (v - m) * greatest(0, s * s - 64) / (s * s) else m end))) as int) as v from st""")
def wiener_filter(spark, sf_dir):
    return R.wiener(px(spark, sf_dir), 3, 3, 8.0)


@query(WITH + "select img_id, y // 2 as y, x // 2 as x, (sum(b) >= 2)::int as b from bits group by img_id, y // 2, x // 2")
def reduce_threshold(spark, sf_dir):
    return R.reduce_bits(bits(spark, sf_dir), 2)


@query(WITH + "select img_id, y // 4 as y, x // 4 as x, cast((2 * sum(v) + 16) // 32 as int) as v from px group by img_id, y // 4, x // 4")
def scale_to_gray(spark, sf_dir):
    return R.scale_down(px(spark, sf_dir), 4)


@query(WITH + "select img_id, y * 2 + dy as y, x * 2 + dx as x, v from px cross join (values (0), (1)) a(dy) cross join (values (0), (1)) b(dx)")
def upscale_integer(spark, sf_dir):
    return R.scale_up(px(spark, sf_dir), 2)


@query(WITH + "select img_id, x as y, 7 - y as x, v from px")
def rotate_90(spark, sf_dir):
    return R.rotate(px(spark, sf_dir), 90, 8, 8)


@query(WITH + """, m as (select img_id, y, x + cast(floor(0.5 * (y + 0.5 - 4) + 0.5) as int) as x, v from px)
select p.img_id, p.y, p.x, coalesce(m.v, 255) as v from px p left join m on m.img_id = p.img_id and m.y = p.y and m.x = p.x""")
def horizontal_shear(spark, sf_dir):
    return R.shear(px(spark, sf_dir), 0.5, 4.0, 8)


_PAIR = WITH + ", a as (select img_id // 2 as img_id, y, x from bits where img_id % 2 = 0 and b = 1), c as (select img_id // 2 as img_id, y, x from bits where img_id % 2 = 1 and b = 1) "


def _pair(spark, sf_dir):
    b = bits(spark, sf_dir).filter("b = 1")
    side = lambda k: b.filter(F.col("img_id") % 2 == k).select(F.expr("img_id div 2").alias("img_id"), "y", "x")
    return side(0), side(1)


for _op, _sql in {"and": "select * from a intersect select * from c", "or": "select * from a union select * from c", "subtract": "select * from a except select * from c", "xor": "(select * from a except select * from c) union all (select * from c except select * from a)"}.items():
    query(_PAIR + _sql, f"pixel_{_op}")(lambda spark, sf_dir, op=_op: R.pixel_set(*_pair(spark, sf_dir), op))

_GRAY = {"invert": "255 - a", "clipped_subtract": "greatest(0, a - b)", "unclipped_subtract": "(a - b + 256) % 256", "clipped_add": "least(255, a + b)", "unclipped_add": "(a + b) % 256", "darkest": "least(a, b)", "lightest": "greatest(a, b)"}


def _gray_pair(spark, sf_dir):
    p = px(spark, sf_dir)
    side = lambda k: p.filter(F.col("img_id") % 2 == k).select(F.expr("img_id div 2").alias("img_id"), "y", "x", "v")
    return side(0), side(1)


@query(WITH + f", j as (select p.img_id // 2 as img_id, p.y, p.x, p.v as a, q.v as b from px p join px q on q.img_id = p.img_id + 1 and p.img_id % 2 = 0 and p.y = q.y and p.x = q.x) select img_id, y, x, {', '.join(f'{e} as {k}' for k, e in _GRAY.items())} from j")
def gray_raster_ops(spark, sf_dir):
    a, b = _gray_pair(spark, sf_dir)
    both = a.join(b.select("img_id", "y", "x", F.col("v").alias("_b")), ["img_id", "y", "x"])
    return both.select("img_id", "y", "x", *[f(F.col("v"), F.col("_b")).cast("int").alias(k) for k, f in R.GRAY_OPS.items()])


@query("select vec_id, list_transform(embedding, lambda e: 255 - least(255, greatest(0, cast(floor((cast(e as double) + 1) * 128) as int)))) as inverted from embeddings")
def raster_map(spark, sf_dir):
    """A pixel function on flat arrays."""
    e = table(spark, sf_dir, "embeddings")
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 128).cast("int"))))
    return e.select("vec_id", R.gray_op_arrays(gray, gray, "invert").alias("inverted"))


@query(WITH + ", j as (select p.img_id // 2 as img_id, p.y, p.x, p.v as a, q.v as b from px p join px q on q.img_id = p.img_id + 1 and p.img_id % 2 = 0 and p.y = q.y and p.x = q.x) select img_id, y, x, case when (x + y) % 3 = 0 then b else a end as v from j")
def combine_images(spark, sf_dir):
    a, b = _gray_pair(spark, sf_dir)
    return R.combine(a, b, a.select("img_id", "y", "x", ((F.col("x") + F.col("y")) % 3 == 0).cast("int").alias("b")))


@query(WITH + "select img_id, y, x, case when v < 128 then v else 9 end as v from px")
def apply_mask(spark, sf_dir):
    return R.apply_mask(px(spark, sf_dir), bits(spark, sf_dir), 9)


@query(WITH + "select p.img_id // 2 as img_id, p.y, p.x, coalesce(q.v, p.v) as v from px p left join px q on q.img_id = p.img_id + 1 and q.y = p.y - 2 and q.x = p.x - 3 where p.img_id % 2 = 0")
def draw_over(spark, sf_dir):
    a, b = _gray_pair(spark, sf_dir)
    return R.draw_over(a, b, 2, 3)


@query(WITH + ", s as (select * from bits) select a.img_id, a.y, a.x, (a.b = 1 and coalesce(r.b, 0) = 1 and coalesce(u.b, 0) = 0)::int as b from s a left join s r on r.img_id = a.img_id and r.y = a.y and r.x = a.x + 1 left join s u on u.img_id = a.img_id and u.y = a.y - 1 and u.x = a.x - 1")
def hit_miss(spark, sf_dir):
    return R.hit_miss(bits(spark, sf_dir), [(0, 0), (0, 1)], [(-1, -1)])


@query(WITH + """, h as (select img_id, v // 4 as bin, count(*) as n, sum((v between 20 and 235)::int) as mid from px group by all), e as (select img_id, round(-sum(n / 64.0::double * log2(n / 64.0::double)), 6) as entropy, sum(mid) / 64.0::double as mid from h group by img_id)
select img_id, entropy, mid, false as is_plate from e""")
def plate_entropy(spark, sf_dir):
    """Tiles of an 8 x 8 raster have a pixel or two, too few for a vote, so that no raster is a plate by its tiles."""
    return R.plate_entropy(px(spark, sf_dir)).select("img_id", "entropy", "mid", "is_plate")


@query(WITH + """, h as (select i.img_id, t.bin::int as bin, coalesce(n, 0) as n from (select distinct img_id from px) i cross join range(256) t(bin) left join (select img_id, v, count(*) as n from px group by all) h on h.img_id = i.img_id and h.v = t.bin),
d as (select *, sum(n) over (partition by img_id order by bin rows between current row and 9 following) as mass from h), b as (select img_id, max(mass) as mass, min(bin) filter (mass = mm) as first from (select *, max(mass) filter (bin <= 246) over (partition by img_id) as mm from d) where bin <= 246 group by img_id),
u as (select h.img_id, h.bin, b.mass, sum(h.n) over (partition by h.img_id order by h.bin) as upto from h join b using (img_id) where h.bin between first and first + 9)
select img_id, min(bin) as level from u where upto >= mass // 2 group by img_id""")
def dominant_level(spark, sf_dir):
    return R.dominant_level(px(spark, sf_dir))


ANGLES = [round(math.pi * k / 12, 12) for k in range(12)]
_ANGLES = ", ".join(f"({i}, {a!r}::double)" for i, a in enumerate(ANGLES))


@query(WITH + f", v as (select img_id, theta, cast(floor(round(x * cos(a) + y * sin(a), 9) + 0.5) as int) as rho, count(*) as votes from bits cross join (values {_ANGLES}) t(theta, a) where b = 1 group by all), r as (select *, row_number() over (partition by img_id order by votes desc, theta, rho) as rank from v) select img_id, theta, rho, votes, rank from r where rank <= 3")
def hough_peaks(spark, sf_dir):
    return R.hough_peaks(R.hough(bits(spark, sf_dir), ANGLES), 3)


SLOPES = [k / 8 for k in range(-4, 5)]
_SLOPES = ", ".join(f"({i}, {s!r}::double)" for i, s in enumerate(SLOPES))


@query(WITH + f""", r as (select img_id, step, y + cast(floor(s * (x - 4) + 0.5) as int) as line, sum(b) as n from bits cross join (values {_SLOPES}) t(step, s) group by all),
d as (select img_id, step, n - lag(n) over (partition by img_id, step order by line) as d from r), c as (select img_id, step, cast(coalesce(sum(d * d), 0) as bigint) as score from d group by all),
k as (select *, row_number() over (partition by img_id order by score desc, step) as r from c) select img_id, step, score, round((select max(score) / avg(score) - 1 from c where c.img_id = k.img_id), 6) as confidence from k where r = 1""")
def skew_angle(spark, sf_dir):
    return R.best_skew(R.skew_scores(bits(spark, sf_dir), SLOPES, 8)).withColumn("confidence", F.round("confidence", 6))


_EVIDENCE = """with e as (select vec_id, vec_id % 7 <> 0 as is_gray, cast((vec_id * 13 % 60) / 100.0 as float) as mid, cast((vec_id * 7 % 20) / 100.0 as float) as dark, cast((vec_id * 3 % 90) / 100.0 as float) as light,
 cast((vec_id * 17 % 100) / 100.0 as float) as cover, cast((vec_id * 5 % 80) / 100.0 as float) as largest, vec_id % 50 as tiles, vec_id % 5 as region_tiles from embeddings),
p as (select *, mid < 0.45::float and ((dark > 0.1::float and light > 0.3::float) or light > 0.7::float) as prior, mid >= 0.1::float or cover >= 0.7::float or largest >= 0.7::float or tiles >= 45 as wide,
 region_tiles >= 2 and (dark >= 0.08::float or region_tiles >= 3) and largest >= 0.06::float as mixed from e)
"""


@query(_EVIDENCE + "select vec_id, case when not is_gray then 'color' when not prior then 'gray' when wide then 'gray' when mixed then 'mixed' else 'bw' end as mode, case when not is_gray then 'global_chroma' when not prior then 'document_prior_absent' when wide then 'widespread_continuous_tone' when mixed then 'localized_continuous_tone_with_document' when tiles > 0 then 'isolated_tone_below_region_minimum' else 'document_without_continuous_tone' end as reason from p")
def color_class(spark, sf_dir):
    i = F.col("vec_id")
    part = lambda k, m: ((i * k % m) / 100.0).cast("float")
    e = F.struct((i % 7 != 0).alias("is_gray"), part(13, 60).alias("mid"), part(7, 20).alias("dark"), part(3, 90).alias("light"), part(17, 100).alias("coverage"), part(5, 80).alias("largest"), (i % 50).alias("tiles"), (i % 5).alias("region_tiles"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    return rows.select("vec_id", rules.color_class(F.col("e")).alias("mode"), rules.color_reason(F.col("e")).alias("reason"))


@query(WITH + """, c as (select img_id, v as r, least(255, v + 10) as g, greatest(0, v - x) as b, y, x from px)
select img_id, y, x, cast((r * 11 + g * 16 + b * 5) // 32 as int) as gray, greatest(abs(r - (r + g + b) // 3), abs(g - (r + g + b) // 3), abs(b - (r + g + b) // 3)) >= 9 as has_cast, cast(least(255, floor(r * greatest(0.2, least(6.0, 245.0 / 200.0)))) as int) as balanced from c""")
def white_balance(spark, sf_dir):
    p = px(spark, sf_dir)
    r, g, b = F.col("v"), F.least(F.lit(255), F.col("v") + 10), F.greatest(F.lit(0), F.col("v") - F.col("x"))
    return p.select("img_id", "y", "x", rules.luma(r, g, b).alias("gray"), rules.has_cast(r, g, b, 9).alias("has_cast"), rules.balance(r, F.lit(200.0)).alias("balanced"))


@query("""
with r as (select conv_id as page, (turn % 10) / 10.0 as y, 0.05 as h, (turn % 4 + 1) * 0.04 as w from conversations), m as (select *, y + h / 2 as mid, w * h as area from r),
s as (select page, count(*) as n, sum(area) as area, count(*) filter (mid <= 0.18 or mid >= 0.82) as n_outer, coalesce(sum(area) filter (not (mid <= 0.18 or mid >= 0.82)), 0) as inner_area from m group by page)
select page, n, n_outer, round(area, 6)::double as area, n <= 4 and area <= 0.025 and inner_area <= 0.020 and n_outer > 0 as is_caption from s
""")
def caption_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("page"), F.lit(0.0).alias("x"), ((F.col("turn") % 10) / 10.0).alias("y"), ((F.col("turn") % 4 + 1) * 0.04).alias("w"), F.lit(0.05).alias("h"))
    return rules.caption_evidence(rows, ["page"]).select("page", "n", "n_outer", F.round("area", 6).alias("area"), "is_caption")


_TONES = rules.tone_table(contrast=30, shadows=20, whites=-10)


@query(WITH + f"select img_id, y, x, ([{', '.join(map(str, _TONES))}])[v + 1] as v from px")
def tone_curve(spark, sf_dir):
    p = px(spark, sf_dir)
    return p.select("img_id", "y", "x", rules.apply_table(F.col("v"), _TONES).alias("v"))


@query(WITH + ", r as (select img_id, y as i, sum(b) as black, 8 as pixels from bits group by all), m as (select *, case when black * 100 >= pixels * 95 then i end as d from r) select img_id, coalesce(max(d), -1) as edge from m group by img_id")
def detect_edge(spark, sf_dir):
    lines = bits(spark, sf_dir).groupBy("img_id", F.col("y").alias("i")).agg(F.sum("b").alias("black"), F.count(F.lit(1)).alias("pixels"))
    return S.detect_edge(lines, ["img_id"])


_CUTS = WITH + """, s as (select img_id, i, n from (select img_id, x as i, sum((v < 110)::int) as n from px group by all) where n > 0),
g as (select *, sum(case when i - p - 1 < 1 then 0 else 1 end) over (partition by img_id order by i) as k from (select *, lag(i) over (partition by img_id order by i) as p from s)),
sp as (select img_id, min(i) as b, max(i) + 1 as e from g group by img_id, k)
"""


def _columns(spark, sf_dir):
    return px(spark, sf_dir).groupBy("img_id", F.col("x").alias("i")).agg(F.sum((F.col("v") < 110).cast("int")).alias("n"))


@query(_CUTS + "select img_id, b, e from sp")
def whitespace_spans(spark, sf_dir):
    return S.content_spans(_columns(spark, sf_dir), ["img_id"], 1, 1)


@query(_CUTS + """, l as (select *, lead(b) over w as nb, min(b) over (partition by img_id) as first, max(e) over (partition by img_id) as last from sp window w as (partition by img_id order by b)),
q as (select *, least(e - first, last - nb) / greatest(e - first, last - nb)::double as ratio, nb - e as gap, (e + nb) / 2.0 as mid from l where nb is not null),
o as (select *, row_number() over (partition by img_id order by gap desc, mid) as r from (select *, max(ratio) over (partition by img_id) as best from q) where best >= 0.25 and ratio >= 0.9 * best),
n as (select img_id, min(b) as b, max(e) as e from sp group by img_id)
select n.img_id, cast(coalesce(o.mid, case when greatest(n.b - 4.0, 4.0 - n.e) > 15 then 4.0 when n.b > 8 - n.e then n.b - 15.0 else n.e + 15.0 end) as double) as cut from n left join o on o.img_id = n.img_id and o.r = 1""")
def cut_position(spark, sf_dir):
    return S.cut_position(S.content_spans(_columns(spark, sf_dir), ["img_id"], 1, 1), ["img_id"], 8, True)


_BITS = {"src": "a", "dst": "c", "not_src": "1 - a", "not_dst": "1 - c", "and": "a & c", "or": "a | c", "xor": "xor(a, c)", "subtract": "case when a = 1 and c = 0 then 1 else 0 end", "subtract_white": "case when a = 0 and c = 1 then 0 else 1 end"}
for _op, _sql in _BITS.items():
    query(WITH + f"select p.img_id // 2 as img_id, y, x, ({_sql})::int as b from (select img_id, y, x, b as a from bits where img_id % 2 = 0) p join (select img_id - 1 as img_id, y, x, b as c from bits where img_id % 2 = 1) q using (img_id, y, x)", f"bit_{_op}")(
        lambda spark, sf_dir, op=_op: R.bit_op(*_bit_pair(spark, sf_dir), op))


def _bit_pair(spark, sf_dir):
    b = bits(spark, sf_dir)
    side = lambda k: b.filter(F.col("img_id") % 2 == k).select(F.expr("img_id div 2").alias("img_id"), "y", "x", "b")
    return side(0), side(1)


def _stretch_sql(black: str, white: str) -> str:
    """Bounds by counting, for each level that occurs, the pixels at or under and at or over it."""
    lo = black if float(black) >= 1 else f"coalesce(min(l) filter ((select count(*) from px q where q.img_id = k.img_id and q.v <= l) > floor({black}::double * 64 + 0.5)), 256)"
    hi = white if float(white) >= 1 else f"coalesce(max(l) filter ((select count(*) from px q where q.img_id = k.img_id and q.v >= l) > floor({white}::double * 64 + 0.5)), -1)"
    return WITH + f""", k as (select distinct img_id, v as l from px), t as (select img_id, {lo} as lo, {hi} as hi from k group by img_id)
select img_id, y, x, cast(case when lo >= hi then case when v <= (lo + hi) // 2 then 0 else 255 end else (255 * (least(hi, greatest(lo, v)) - lo) + (hi - lo) // 2) // (hi - lo) end as int) as v from px join t using (img_id)"""


for _name, _black, _white in (("stretch_range", "0.05", "0.1"), ("stretch_range_fixed", "40", "0.02"), ("stretch_range_flat", "0.6", "0.7")):
    query(_stretch_sql(_black, _white), _name)(lambda spark, sf_dir, b=float(_black), w=float(_white): R.stretch_range(px(spark, sf_dir), b, w))


@query("select vec_id as img_id, y::int as y, x::int as x, case when y in (0, 3) or x in (0, 4) then 7 else 250 end as v from embeddings cross join range(4) a(y) cross join range(5) b(x)")
def framed_raster(spark, sf_dir):
    return R.framed(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id")), 5, 4, 250, 7)


_RGB = WITH + ", c as (select img_id, y, x, v as r, least(255, v + 10) as g, greatest(0, v - 9 * x) as b, (v * 5 + x * 17 + y) % 256 as l from px)"


def _rgb(spark, sf_dir):
    v = F.col("v")
    return px(spark, sf_dir).select("img_id", "y", "x", v.alias("r"), F.least(F.lit(255), v + 10).alias("g"), F.greatest(F.lit(0), v - 9 * F.col("x")).alias("b"), ((v * 5 + F.col("x") * 17 + F.col("y")) % 256).alias("l"))


def _brightness_sql(wr: float, wb: float) -> str:
    cut = lambda e: f"greatest(0, least(255, cast(trunc({e}) as int)))"
    wr_, wb_, wg_ = f"{wr!r}::double", f"{wb!r}::double", f"(1 - {wr!r}::double - {wb!r}::double)"
    return _RGB + f""", s as (select *, l - ({wr_} * r + {wg_} * g + {wb_} * b) as up from c), t as (select *, r + up as nr, b + up as nb from s)
select img_id, y, x, {cut("nr + 0.5::double")} as r, {cut(f"(l - nr * {wr_} - nb * {wb_}) / {wg_} + 0.5::double")} as g, {cut("nb + 0.5::double")} as b from t"""


for _kind, (_wr, _wb) in rules.BRIGHTNESS.items():
    query(_brightness_sql(_wr, _wb), f"brightness_{_kind}")(
        lambda spark, sf_dir, kind=_kind: _rgb(spark, sf_dir).select("img_id", "y", "x", rules.with_brightness(F.col("r"), F.col("g"), F.col("b"), F.col("l"), kind).alias("_c")).select("img_id", "y", "x", "_c.*"))


@query(_RGB + "select img_id, y, x, cast(floor((r + (b - r) * least(1.0::double, greatest(0.0::double, l / 200.0::double - 0.1::double))) / 255 * 65535 + 0.5::double) as int) >> 8 as v from c")
def color_interpolation(spark, sf_dir):
    return _rgb(spark, sf_dir).select("img_id", "y", "x", rules.blend(F.col("r"), F.col("b"), F.col("l") / 200.0 - 0.1).alias("v"))


@query(WITH + "select img_id, y, case when sum(x % 3) > 0 then cast((sum(v * (x % 3)) + sum(x % 3) // 2) // sum(x % 3) as int) end as v from px group by img_id, y")
def color_mix(spark, sf_dir):
    return px(spark, sf_dir).groupBy("img_id", "y").agg(rules.mixed_level(F.col("v"), F.col("x") % 3).alias("v"))


@query(WITH + """, m as (select img_id, y + cast(floor(-0.3 * (x + 0.5 - 4) + 0.5) as int) as y, x, v from px)
select p.img_id, p.y, p.x, coalesce(m.v, 9) as v from px p left join m on m.img_id = p.img_id and m.y = p.y and m.x = p.x""")
def vertical_shear(spark, sf_dir):
    return R.shear(px(spark, sf_dir), -0.3, 4.0, 8, horizontal=False, background=9)
