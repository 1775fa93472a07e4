"""Kernels on the rasters of the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions as G
from ..operators import staleness as T
from .raster_queries import WITH, bits, px
from .registry import query

#: Each black pixel with the first pixel (row by row) that it reaches.
_LABELS = WITH.replace("with ", "with recursive ", 1) + """, k as (select img_id, y, x, y * 8 + x as p from bits where b = 1),
e as (select a.img_id, a.p as p, b.p as q from k a join k b on a.img_id = b.img_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.p <> b.p {more}),
r(img_id, p, reach) as (select img_id, p, p from k union select r.img_id, r.p, e.q from r join e on e.img_id = r.img_id and e.p = r.reach),
m as (select img_id, p, min(reach) as root from r group by img_id, p)
"""


@query(_LABELS.format(more="") + """select img_id, cast(row_number() over (partition by img_id order by root) as int) as label, min(p % 8)::bigint as x0, min(p // 8)::bigint as y0, max(p % 8 + 1)::bigint as x1, max(p // 8 + 1)::bigint as y1, count(*) as n from m group by img_id, root""")
def connected_components(spark, sf_dir):
    return G.components(bits(spark, sf_dir))


@query(_LABELS.format(more="and (a.y = b.y or a.x = b.x)") + """, s as (select img_id, root from m where p = 27) select b.img_id, b.y, b.x, coalesce(m.root = s.root, false)::int as b from bits b left join m on m.img_id = b.img_id and m.p = b.y * 8 + b.x left join s on s.img_id = b.img_id""")
def seed_fill(spark, sf_dir):
    return G.seed_fill(bits(spark, sf_dir), (3, 3), eight=False)


@query(WITH + "select a.img_id, a.y, a.x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::bigint as d from bits a join bits b on a.img_id = b.img_id and b.b = 1 group by all")
def distance_map(spark, sf_dir):
    return G.distances(bits(spark, sf_dir))


@query(WITH + """, l as (select img_id // 2 as img_id, y, x, y + 1 as label from bits where b = 1 and img_id % 2 = 0), o as (select img_id // 2 as img_id, y, x, x + 1 as label from bits where b = 1 and img_id % 2 = 1),
m as (select img_id, max(label) as most from l group by img_id), n as (select o.img_id, o.y, o.x, o.label + coalesce(most, 0) as label from o left join m using (img_id))
select coalesce(n.img_id, l.img_id) as img_id, coalesce(n.y, l.y) as y, coalesce(n.x, l.x) as x, coalesce(n.label, l.label) as label from l full join n on l.img_id = n.img_id and l.y = n.y and l.x = n.x""")
def unite_label_maps(spark, sf_dir):
    b = bits(spark, sf_dir).filter("b = 1")
    side = lambda k, c: b.filter(F.col("img_id") % 2 == k).select(F.expr("img_id div 2").alias("img_id"), "y", "x", (F.col(c) + 1).alias("label"))
    return T.add_components(side(0, "y"), side(1, "x"), ["img_id"])


@query()
def despeckle(spark, sf_dir):
    return G.despeckle(bits(spark, sf_dir), dpi=30)


def _kernel(method: str) -> None:
    query(name=f"binarize_{method}")(lambda spark, sf_dir: G.binarize(px(spark, sf_dir), method, 5))


for _method in ("mean", "bimodal", "peak", "mokji", "grad", "robust", "engraving", "multiscale", "edge_div", "gatos", "grain"):
    _kernel(_method)
