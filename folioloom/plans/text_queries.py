"""Text, recognised words and bibliographic records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query, table


def _isbn(i):
    """Digits from a key: every second one with its right check digit."""
    body = F.concat(F.lit("978"), F.lpad((i * 7919 % 1000000000).cast("string"), 9, "0"))
    total = sum(F.substring(body, k + 1, 1).cast("int") * (1 if k % 2 == 0 else 3) for k in range(12))
    return F.concat(body, F.when(i % 2 == 0, (10 - total % 10) % 10).otherwise(total % 10).cast("int").cast("string"))


_ISBN = "with b as (select c_custkey as k, '978' || lpad(cast(c_custkey * 7919 % 1000000000 as varchar), 9, '0') as body from customer), t as (select *, list_sum([cast(substr(body, i::int, 1) as int) * (case when i % 2 = 1 then 1 else 3 end) for i in range(1, 13)]) as total from b), i as (select k, body || cast(case when k % 2 = 0 then (10 - total % 10) % 10 else total % 10 end as int) as isbn from t)"
_VALID13 = "list_sum([cast(substr(isbn, i::int, 1) as int) * (case when i % 2 = 1 then 1 else 3 end) for i in range(1, 14)]) % 10 = 0"


@query(_ISBN + f" select k, isbn, {_VALID13} as is_valid from i")
def isbn13_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _isbn(F.col("c_custkey")).alias("isbn"))
    return c.select("k", "isbn", X.is_isbn13(F.col("isbn")).alias("is_valid"))


@query("""
with i as (select c_custkey as k, lpad(cast(c_custkey * 104729 % 1000000000 as varchar), 9, '0') || case when c_custkey % 6 = 0 then 'x' when c_custkey % 3 = 0 then 'X' else cast(c_custkey % 10 as varchar) end as isbn from customer)
select k, isbn, list_sum([(case when upper(substr(isbn, j::int, 1)) = 'X' then 10 else cast(substr(isbn, j::int, 1) as int) end) * (11 - j) for j in range(1, 11)]) % 11 = 0 as is_valid from i
""")
def isbn10_check(spark, sf_dir):
    i = F.col("c_custkey")
    isbn = F.concat(F.lpad((i * 104729 % 1000000000).cast("string"), 9, "0"), F.when(i % 6 == 0, "x").when(i % 3 == 0, "X").otherwise((i % 10).cast("string")))
    return table(spark, sf_dir, "customer").select(i.alias("k"), isbn.alias("isbn")).select("k", "isbn", X.is_isbn10(F.col("isbn")).alias("is_valid"))


@query(_ISBN + f" select k, case when {_VALID13} then isbn end as found from i")
def isbn_find(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), _isbn(F.col("c_custkey")).alias("isbn"))
    dashed = F.concat(F.substring("isbn", 1, 3), F.lit("-"), F.substring("isbn", 4, 5), F.lit(" "), F.substring("isbn", 9, 5))
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("see e-ISBN-13: "), dashed, F.lit("."))).otherwise(F.concat(F.lit("no. "), dashed, F.lit(" end")))
    return c.select("k", X.find_isbn(said).alias("found"))


@query(r"select l_orderkey, l_linenumber, nullif(regexp_extract(cast(cast(trunc(l_extendedprice) as int) as varchar) || ' ' || l_partkey % 3000, '\b(1[5-9]\d{2}|20\d{2})\b', 1), '') as year from lineitem")
def year_extract(spark, sf_dir):
    said = F.concat_ws(" ", F.col("l_extendedprice").cast("int").cast("string"), (F.col("l_partkey") % 3000).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.find_year(said).alias("year"))


_ALL_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10)))))::int as i from documents"


@query(rf"""
with d as ({_ALL_LINES}), w as (select doc_id, i, line, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') as ws from d)
select doc_id, i, len(ws) between 1 and 4 and len(list_filter(ws, lambda x: not regexp_matches(x, '^\p{{Lu}}[\p{{L}}.''-]*$'))) = 0 as is_name, regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])\p{{Lu}}') as is_name_line from w
""")
def looks_like_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return d.select("doc_id", "i", X.looks_like_name(F.col("line")).alias("is_name"), F.col("line").rlike(r"(^|[^\p{L}\p{N}_])\p{Lu}").alias("is_name_line"))


@query("""
with n as (select c_custkey, case when c_custkey % 2 = 0 then upper(c_mktsegment) || '  AND ' || upper(c_name) else c_name || ' And' end as name from customer)
select c_custkey, case when regexp_matches(name, '\\p{Ll}') then name else array_to_string([case when lower(w) in ('and', 'with') then lower(w) else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end for w in list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '')], ' ') end as name from n
""")
def name_case(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit("  AND "), F.upper("c_name"))).otherwise(F.concat("c_name", F.lit(" And")))
    return c.select("c_custkey", X.name_case(name).alias("name"))


@query("""
with c as (select c_custkey, list_filter(list_transform(string_split(c_mktsegment || ' von ' || c_name || '; ' || c_name || ' ;;', ';'), lambda x: trim(x)), lambda x: x <> '') as names from customer)
select c_custkey, [array_to_string(regexp_split_to_array(n, '\\s+')[:-2], ' ') for n in names] as first, [regexp_split_to_array(n, '\\s+')[-1] for n in names] as last from c
""")
def creators(spark, sf_dir):
    said = F.concat("c_mktsegment", F.lit(" von "), "c_name", F.lit("; "), "c_name", F.lit(" ;;"))
    c = table(spark, sf_dir, "customer").select("c_custkey", X.parse_creators(said).alias("c"))
    return c.select("c_custkey", F.col("c.first").alias("first"), F.col("c.last").alias("last"))


@query(r"""
with p as (select page_id, case when page_id % 3 = 0 then 'A. B.' else '' end as authors, case when page_id % 7 = 0 then '' else url end as title, case when page_id % 2 = 0 then '1999' else '' end as year, 'scan' || page_id as fallback from pages),
r as (select page_id, case when title = '' then fallback else case when authors <> '' then authors || ' - ' else '' end || title || case when year <> '' then ' (' || year || ')' else '' end end as raw from p)
select page_id, rtrim(substr(regexp_replace(regexp_replace(regexp_replace(raw, '[/\\:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 120)) || '.pdf' as name from r
""")
def pdf_name(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    name = X.pdf_name(F.when(i % 3 == 0, "A. B.").otherwise(""), F.when(i % 7 == 0, "").otherwise(F.col("url")), F.when(i % 2 == 0, "1999").otherwise(""), F.concat(F.lit("scan"), i.cast("string")))
    return p.select("page_id", name.alias("name"))


@query("""
with e as (select event_id, greatest(0, cast(trunc(value * 40000) as bigint)) as t from events), s as (select *, t // 1000 as s from e)
select event_id, case when t < 60000 then cast(round(t / 1000.0::double, 1) as varchar) || ' s' when t < 3600000 then (s // 60) || ' m ' || (s % 60) || ' s (' || s || ' s)' else (s // 3600) || ' h ' || (s % 3600) // 60 || ' m (' || s || ' s)' end as text from s
""")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.duration((F.col("value") * 40000).cast("long")).alias("text"))


_WORDS = "w as (select conv_id as page_id, turn as seq, text, cast((turn * 37 % 100) / 100.0 as double) as conf from conversations)"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), "text", ((F.col("turn") * 37 % 100) / 100.0).alias("conf"), F.lit(2.0).alias("w"), F.lit(3.0).alias("h"), F.lit(600.0).alias("area"))


@query(f"""with {_WORDS} select page_id, count(*) as n_words, cast(sum(length(text)) as bigint) as n_chars, round(avg(conf), 6) as mean_conf, min(conf) as min_conf, count(*) filter (conf < 0.5) as n_unsure,
 sha256(string_agg(text, chr(31) order by seq, text)) as text_sha256, round(count(*) * 6.0 / 600.0, 6) as area_share from w group by page_id""")
def ocr_metrics(spark, sf_dir):
    return X.ocr_metrics(_words(spark, sf_dir), ["page_id"], "area").withColumns({"mean_conf": F.round("mean_conf", 6), "area_share": F.round("area_share", 6)})


@query(f"with {_WORDS} select page_id, string_agg(text, ' ' order by seq, text) as text from w group by page_id")
def full_text(spark, sf_dir):
    return X.full_text(_words(spark, sf_dir), ["page_id"])


@query("""
with f as (select page_id as doc_id, url as path from pages), w as (select doc_id, list(quality * 2 + toxic order by quality, toxic) as words from labels group by doc_id)
select path, doc_id, words from f join w using (doc_id)
""")
def ocr_text_layer(spark, sf_dir):
    """Pages with an existing output file and recognised words, and the words in order."""
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"))
    w = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("quality") * 2 + F.col("toxic"))).alias("words"))
    return f.join(w, "doc_id").select("path", "doc_id", "words")


def _lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    h = (F.col("turn") * 13 % 7 + 10).cast("double")
    return c.select(F.col("conv_id").alias("book"), F.col("turn").alias("i"), "text", h.alias("height"), (F.col("turn") * 20).cast("double").alias("top"), F.lit(0.9).alias("conf"), F.lit(100.0).alias("page_h"))


_LINES = "l as (select conv_id as book, turn as i, text, cast(turn * 13 % 7 + 10 as double) as height, cast(turn * 20 as double) as top from conversations)"


@query(rf"""with {_LINES}, f as (select *, row_number() over (partition by book order by height desc, top, text) as r from l where top <= 60 and length(trim(text)) >= 3 and regexp_matches(text, '\p{{L}}')) select book, text as title from f where r = 1""")
def title_pick(spark, sf_dir):
    return X.pick_title(_lines(spark, sf_dir), ["book"])


@query(r"""
with l as (select conv_id as book, turn as i, case when turn % 3 = 1 then 'Edited by ' || case when conv_id % 2 = 0 then 'ANN LEE' else '' end else case when turn % 3 = 2 then 'Bob With Ray' else 'x' end end as text, conv_id % 7 = 0 as in_title from conversations),
f as (select book, i, case when regexp_extract(trim(text), '(?i)^edited by\s*(.*)$', 1) <> '' then regexp_extract(trim(text), '(?i)^edited by\s*(.*)$', 1) else lead(trim(text)) over (partition by book order by i) end as name, regexp_matches(text, '(?i)^edited by') as hit, in_title from l),
r as (select *, row_number() over (partition by book order by i) as r from f where hit and not in_title and regexp_matches(coalesce(name, ''), '\p{Lu}'))
select book, 'editor' as role, case when name = 'ANN LEE' then 'Ann Lee' else name end as name from r where r = 1
""")
def byline(spark, sf_dir):
    c, i = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    text = F.when(i == 1, F.concat(F.lit("Edited by "), F.when(F.col("conv_id") % 2 == 0, "ANN LEE").otherwise(""))).when(i == 2, "Bob With Ray").otherwise("x")
    rows = c.select(F.col("conv_id").alias("book"), F.col("turn").alias("i"), text.alias("text"), (F.col("conv_id") % 7 == 0).alias("in_title"))
    return X.byline(rows, ["book"])


@query(r"""
with p as (select conv_id as book, turn as pos, 'in ' || (1400 + (conv_id * 7 + turn * 131) % 700) || ' and' as text from conversations),
k as (select book, pos, nullif(regexp_extract(text, '\b(1[5-9]\d{2}|20\d{2})\b', 1), '') as year, row_number() over (partition by book order by pos) as k from p)
select book, min_by(year, k) filter (k <= 8 and year is not null) as year, cast(null as varchar) as isbn from k group by book
""")
def book_metadata(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), F.concat(F.lit("in "), (1400 + (F.col("conv_id") * 7 + F.col("turn") * 131) % 700).cast("string"), F.lit(" and")).alias("text"))
    return X.guess_metadata(p, ["book"])


@query("select event_id, cast(json_extract(props, '$.k') as int) as k, event_type from events where json_extract(props, '$.k') is not null")
def sidecar_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.filter("p.k is not null").select("event_id", F.col("p.k").alias("k"), "event_type")


@query("""
select o_orderkey, 'T' || o_orderkey || case when o_orderkey % 2 = 0 then ': Sub' else '' end as title, case when o_orderkey % 3 = 0 then 'P1; P2' else '' end as publisher, cast(1990 + o_orderkey % 30 as varchar) as year from orders
""")
def catalogue_record(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    json = F.concat(F.lit('{"title": "T'), k, F.lit('", "subtitle": "'), F.when(F.col("o_orderkey") % 2 == 0, "Sub").otherwise(""), F.lit('", "publish_date": "May '), (1990 + F.col("o_orderkey") % 30).cast("string"), F.lit('"'), F.when(F.col("o_orderkey") % 3 == 0, ', "publishers": [{"name": "P1"}, {"name": "P2"}]').otherwise(""), F.lit("}"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", X.parse_open_record(json).alias("r"))
    return o.select("o_orderkey", "r.title", "r.publisher", "r.year")


@query()
def line_clustering(spark, sf_dir):
    """Recognised words to lines: words of a conversation's turn stand for the words of a page."""
    c = table(spark, sf_dir, "conversations")
    words = c.select(F.col("conv_id").alias("page_id"), "turn", F.posexplode(F.split("text", " ")).alias("k", "text"))
    y = (F.col("turn") * 30 + F.floor(F.col("k") / 10) * 12 + F.col("k") % 3).cast("double")
    return X.cluster_lines(words.select("page_id", "text", (F.col("k") % 10 * 50).cast("double").alias("x"), y.alias("y"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"), F.lit(0.9).alias("conf")), ["page_id"])
