"""The registered queries opN_<name> and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard, langid, mixing, packing, quality, sharding, tokenio, toxicity, urlfilter
from .common import attach, crc_fold, read_table

#: The public tokenizer file that op10 uses, by name.
TOKENIZER = "word_bpe_49k.json"


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    attach(spark)
    return read_table(spark, sf_dir, "documents").select(*columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir, "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir, "doc_id", "text", "lang"), read_table(spark, sf_dir, "labels")
    held = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(True))
    model = toxicity.train(docs.filter(~held), labels.filter(~held).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rules(_docs(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text", "lang")
    held = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(True))
    out = langid.identify(docs, langid.learn_all(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_docs(spark, sf_dir, "doc_id", "text"), words=3, percent=90, links=True)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir, "doc_id", "text", "source"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_docs(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir, "doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages are the labels of the documents with their id: bad if toxic or of no quality."""
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urlfilter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenio.round_trip(_docs(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(TOKENIZER))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_toxicity, op3_quality, op4_language, op5_jaccard_join, op6_packing, op7_mixing, op8_sharding, op9_url_filter, op10_token_output)
    return {f.__name__: f for f in found}


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""

OP7 = f"""
with d as (
  select doc_id, source, cast({_WORDS} as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (array[5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 2 * source_size as cap from s),
o as (select *, cap / weight as ratio, 1.5 * sum(source_size) over () as budget,
    coalesce(sum(cap) over (order by cap / weight, weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (order by cap / weight, weight, source nulls last rows between current row and unbounded following) as free,
    row_number() over (order by cap / weight, weight, source nulls last) as nr from w),
l as (select min_by(cast((budget - capped) as double) / cast(free as double), nr) filter (cast((budget - capped) as double) / cast(free as double) <= ratio) as level from o),
t as (select source, source_size, least(cast(cap as double), level * weight) as target from w, l),
f as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes from t),
h as (select d.source, h, sum(size) as tokens from d group by all),
u as (select h.source, h, tokens, sum(tokens) over (partition by h.source order by h) as upto, target - passes * source_size as need
  from h join f on h.source is not distinct from f.source),
c as (select source, max(case when upto < need then h + 1 when upto - tokens < need and upto - need <= need - (upto - tokens) then h + 1 else 0 end) as cut
  from u where need > 0 group by source)
select doc_id, size, f.source_size, target, cast(size * (passes + case when h < coalesce(cut, 0) then 1 else 0 end) as bigint) as taken
from d join f on d.source is not distinct from f.source left join c on d.source is not distinct from c.source
"""

#: Rates of op3 as in ``quality.RATES``, on the counts' names in the SQL.
_RATES = ", ".join(f"('{k}', case when {bottom} > 0 then {top} * {scale} // {bottom} else 0 end)" for k, (top, bottom, scale, _) in quality.RATES.items())
_SLACK = "case rate " + " ".join(f"when '{k}' then {v[3]}" for k, v in quality.RATES.items()) + " end"


def _quartiles(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""{name}_m as (select {by}rate, bin, sum(n) as n from sketch group by {by}rate, bin),
{name}_r as (select *, sum(n) over (partition by {by}rate order by bin) as upto, sum(n) over (partition by {by}rate) as texts from {name}_m),
{name}_q as (select {by}rate, max(texts)::double as texts, min(bin) filter (upto * 4 >= texts) as b1, min(bin) filter (upto * 4 >= texts * 3) as b3 from {name}_r group by {by}rate),
{name} as (select *, (case when b1 < 32 then b1 else ((b1 % 16 + 17)::bigint << (b1 // 16 - 1)) - 1 end)::double as q1, (case when b3 < 32 then b3 else ((b3 % 16 + 17)::bigint << (b3 // 16 - 1)) - 1 end)::double as q3 from {name}_q)"""


def _drawn(name: str, own: str, parent: str, keys: str, same: str) -> str:
    mean = lambda q: f"(o.texts * o.{q} + {float(quality.LEAST)}::double * p.{q}) / (o.texts + {float(quality.LEAST)}::double) as {q}"
    return f"{name} as (select {keys}, o.rate, {mean('q1')}, {mean('q3')} from {own} o join {parent} p on o.rate = p.rate{same})"


OP3 = f"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from win) where n > 1),
rep as (select doc_id, count(distinct i + k) as n from twice cross join range(8) r(k) group by doc_id),
line as (select doc_id, l from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup as (select doc_id, count(*) as lines, count(*) - count(distinct l) as dups from line group by doc_id),
c as (select doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(dups, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(lines, 0)::bigint as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals,
  coalesce(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])), 0)::bigint as n_stutters from d left join rep using (doc_id) left join dup using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
v as (select f.*, r.rate, r.value::bigint as value from f, lateral (values {_RATES}) r(rate, value)),
b as (select *, greatest(length(bin(value)) - 5, 0) as up from v),
sketch as (select lang, source, rate, up * 16 + (value >> up) as bin, count(*) as n from b where not base_failed group by all),
{_quartiles("q_all", "")}, {_quartiles("q_lang", "lang")}, {_quartiles("q_own", "lang, source")},
{_drawn("d_lang", "q_lang", "q_all", "o.lang", "")}, {_drawn("d_own", "q_own", "d_lang", "o.lang, o.source", " and o.lang is not distinct from p.lang")},
g as (select lang, source, rate, q1 - ({quality.REACH} * (q3 - q1) + {_SLACK}) as low, q3 + ({quality.REACH} * (q3 - q1) + {_SLACK}) as high from d_own),
o as (select v.doc_id, bool_or(coalesce(value > g.high, false) or (v.rate = 'word_length' and coalesce(value < g.low, false))) as off
  from v left join g on g.lang is not distinct from v.lang and g.source is not distinct from v.source and g.rate = v.rate group by v.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not off as kept from f join o using (doc_id)
"""

OP5 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.reach),
k as (select doc_id, min(reach) as component_id from r group by doc_id),
h as (select doc_id, md5(string_agg(g, '|' order by g)) as h from s group by doc_id), e as (select doc_id, min(doc_id) over (partition by h) as class_id from h),
c as (select x.class_id, count(distinct y.class_id) as n_links from l join e x on x.doc_id = a join e y on y.doc_id = b where x.class_id <> y.class_id group by x.class_id)
select k.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(e.class_id, k.doc_id) as class_id, component_id, coalesce(n_links, 0)::bigint as n_links
from k left join n using (doc_id) left join e using (doc_id) left join c on c.class_id = e.class_id
"""

_MOMENTS = "case when sum({m} * (1 - {m}) * ({n} - 1)) > 0 then round(least(1000.0, greatest(2.0, 1 / greatest((sum({n} * ({b} / {n}::double - {m}) * ({b} / {n}::double - {m})) - sum({m} * (1 - {m}))) / greatest(sum({m} * (1 - {m}) * {n}) - sum({m} * (1 - {m})), 1e-9), 1e-9) - 1)), 6) else 1000.0 end"

OP9 = rf"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
w as (select doc_id as page_id, max(greatest(toxic, 1 - quality)) as bad from labels group by doc_id),
e as (select host, string_split(host, '.') as l, length(l[-1]) = 2 and coalesce(l[-2] in {urlfilter.SECOND_LEVEL}, false) as deep, count(bad) as n, coalesce(sum(bad), 0) as bad from p left join w using (page_id) where host <> '' group by host),
a as (select host, n, bad, array_to_string(case when deep then l[-3:] else l[-2:] end, '.') as domain, array_to_string(case when deep then l[-2:] else l[-1:] end, '.') as suffix from e), h as (select * from a where n > 0),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all), s as (select suffix, sum(n) as n, sum(bad) as bad from d group by all),
g as (select (sum(bad) + 0.5) / (sum(n) + 1.0) as m from s),
ks as (select {_MOMENTS.format(n="n", b="bad", m="m")} as k from s, g), sm as (select suffix, (bad + k * m) / (n + k) as m from s, g, ks),
kd as (select {_MOMENTS.format(n="d.n", b="d.bad", m="sm.m")} as k from d join sm using (suffix)), dm as (select domain, (bad + k * m) / (n + k) as m from d join sm using (suffix), kd),
kh as (select {_MOMENTS.format(n="h.n", b="h.bad", m="dm.m")} as k from h join dm using (domain)),
hk as (select host, n, bad, coalesce(dm.m, sm.m, g.m) as m, case when dm.m is not null then kh.k when sm.m is not null then kd.k else ks.k end as k from a left join dm using (domain) left join sm using (suffix), g, kh, kd, ks),
hm as (select host, n, (bad + k * m) / (n + k) as r, n + k as t from hk), o as (select host, n, r, r - 1.645 * sqrt(r * (1 - r) / (t + 1)) as low from hm),
f as (select *, '.' || host as dotted from p left join o using (host)),
x as (select *, case when host = 'example.org' or ends_with(dotted, '.example.org') then case when starts_with(path, '/es/') then 'example.org/es/' when starts_with(path, '/en/1') then 'example.org/en/1' end end as deep from f),
y as (select *, coalesce(deep, case when ends_with(dotted, '.com') and starts_with(path, '/fr/') then 'com/fr/' when ends_with(dotted, '.com') and starts_with(path, '/de/') then 'com/de/' when ends_with(dotted, '.org') and starts_with(path, '/') then 'org/' end) as rule from x)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when low > 0.5 then 'block' else 'allow' end as verdict, case when n > 0 then round(r, 6) end as bad_rate, case when n > 0 then round(low, 6) end as bad_rate_lower from y
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_quality": OP3, "op5_jaccard_join": OP5, "op7_mixing": OP7, "op9_url_filter": OP9}
