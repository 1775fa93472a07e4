"""Text and bibliographic functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The patterns that mark an ISBN, a year, a byline, and a name.
LABELLED_ISBN = r"(?i)(?:e-\s*)?ISBN(?:[- ]?1[03])?\s*:?\s*([0-9][0-9\- ]{8,16}[0-9Xx])"
BARE_ISBN = r"\b(97[89][0-9\- ]{10,14}[0-9])\b"
YEAR = r"\b(1[5-9]\d{2}|20\d{2})\b"
NAME_TOKEN = r"^\p{Lu}[\p{L}.'-]*$"
BYLINE = r"(?i)^(edited by|translated by|written by|by)\b\s*(.*)$"


def _digit(s: Column, i: Column) -> Column:
    c = F.substring(s, i, F.lit(1))
    return F.when(F.upper(c) == "X", 10).otherwise(c.try_cast("int"))


def is_isbn13(s: Column) -> Column:
    """13 digits whose sum, weighted 1, 3, 1, 3 and so on, is a multiple of 10."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, i: a + _digit(s, i) * F.when(i % 2 == 1, 1).otherwise(3))
    return F.when(s.rlike(r"^\d{13}$"), total % 10 == 0).otherwise(False)


def is_isbn10(s: Column) -> Column:
    """9 digits and a digit or X, of either case, whose sum, weighted 10 to 1, is a multiple of 11."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, i: a + _digit(s, i) * (11 - i))
    return F.when(s.rlike(r"^\d{9}[\dXx]$"), total % 11 == 0).otherwise(False)


def find_isbn(text: Column) -> Column:
    """A labelled ISBN-13, else a bare one, else the first labelled ISBN-10, as digits; null if there is none."""
    norm = lambda found: F.transform(found, lambda s: F.upper(F.regexp_replace(s, r"[^0-9Xx]", "")))
    labelled = norm(F.regexp_extract_all(text, F.lit(LABELLED_ISBN), F.lit(1)))
    bare = norm(F.regexp_extract_all(text, F.lit(BARE_ISBN), F.lit(1)))
    first = lambda found, test: F.get(F.filter(found, test), F.lit(0))
    return F.coalesce(first(labelled, is_isbn13), first(bare, is_isbn13), first(labelled, is_isbn10))


def find_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, YEAR, 1), F.lit(""))


def looks_like_name(text: Column) -> Column:
    """One to four words, each with a capital first and letters, points, apostrophes and hyphens after."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return (F.size(words) >= 1) & (F.size(words) <= 4) & F.forall(words, lambda w: w.rlike(NAME_TOKEN))


def looks_like_name_line(text: Column) -> Column:
    return text.rlike(r"\b\p{Lu}[\p{L}.'-]*")


def name_case(text: Column) -> Column:
    """A name all in capitals in title case, with its ``and`` and ``with`` in lower case; any other as it is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    title = lambda w: F.when(F.lower(w).isin("and", "with"), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.when(text.rlike(r"\p{Ll}"), text).otherwise(F.array_join(F.transform(words, title), " "))


def byline_role(keyword: Column) -> Column:
    k = F.lower(keyword)
    return F.when(k == "edited by", "editor").when(k == "translated by", "translator").otherwise("author")


def byline(lines: DataFrame, by: list[str]) -> DataFrame:
    """The first byline among lines (by, i, text, in_title): role and name, which follows on its line or is the next line."""
    w = W.partitionBy(*by).orderBy("i")
    own = F.trim(F.regexp_extract(F.trim("text"), BYLINE, 2))
    found = lines.withColumns({"_key": F.regexp_extract(F.trim("text"), BYLINE, 1), "_own": own, "_next": F.lead(F.trim("text")).over(w)})
    name = F.when(F.col("_own") != "", F.col("_own")).otherwise(F.col("_next"))
    hits = found.withColumn("_name", name).filter((F.col("_key") != "") & ~F.col("in_title") & looks_like_name_line(F.coalesce("_name", F.lit(""))))
    first = hits.groupBy(*by).agg(F.min_by(F.struct("_key", "_name"), "i").alias("_m"))
    return first.select(*by, byline_role(F.col("_m._key")).alias("role"), name_case(F.col("_m._name")).alias("name"))


def positional_author(lines: DataFrame, by: list[str]) -> DataFrame:
    """The first line below the title (by, i, text, height, title_i, title_height) of 35 to 90 % of its height that looks like a name."""
    ratio = F.col("height") / F.col("title_height")
    hits = lines.filter((F.col("i") > F.col("title_i")) & ratio.between(0.35, 0.90) & looks_like_name(F.col("text")))
    return hits.groupBy(*by).agg(name_case(F.min_by("text", "i")).alias("name"))


def pick_title(lines: DataFrame, by: list[str]) -> DataFrame:
    """The tallest line (by, text, height, top, conf, page_h) in the upper 60 % with three characters and a letter, the upper of equal ones."""
    fit = lines.filter((F.col("top") <= 0.6 * F.col("page_h")) & (F.length(F.trim("text")) >= 3) & F.col("text").rlike(r"\p{L}") & (F.col("conf") >= 0.3))
    return fit.groupBy(*by).agg(F.min_by("text", F.struct(-F.col("height"), F.col("top"), F.col("text"))).alias("title"))


def cluster_lines(words: DataFrame, by: list[str]) -> DataFrame:
    """Words (by, text, x, y, w, h, conf) to lines (by, i, text, height, center_y, top, conf).

    Words in order of their centres join the line above while they lie within 0.6 of the median height
    from its running mean; a fold over the words of one page.
    """
    center = F.col("y") + F.col("h") / 2
    listed = words.groupBy(*by).agg(F.median(F.when(F.col("h") > 0, F.col("h"))).alias("_mh"), F.array_sort(F.collect_list(F.struct(center.alias("cy"), "x", "y", "h", "conf", "text"))).alias("_w"))
    rows = listed.filter("_mh > 0")
    kind = dict(rows.dtypes)["_w"]
    start = F.struct(F.array().cast(f"array<{kind}>").alias("lines"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def add(a, word):
        near = (a["n"] > 0) & (F.abs(word["cy"] - a["sum"] / F.greatest(a["n"], F.lit(1))) <= 0.6 * F.col("_mh"))
        last = F.size(a["lines"])
        joined = F.concat(F.slice(a["lines"], 1, F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.get(a["lines"], last - 1), F.array(word))))
        opened = F.concat(a["lines"], F.array(F.array(word)))
        return F.struct(F.when(near, joined).otherwise(opened).alias("lines"), (F.when(near, a["sum"]).otherwise(0.0) + word["cy"]).alias("sum"), (F.when(near, a["n"]).otherwise(0) + 1).alias("n"))

    folded = rows.select(*by, F.posexplode(F.aggregate("_w", start, add)["lines"]).alias("i", "_l"))
    total = lambda f: F.aggregate("_l", F.lit(0.0), lambda a, x: a + f(x))
    text = F.array_join(F.transform(F.array_sort(F.transform("_l", lambda x: F.struct(x["x"].alias("x"), x["text"].alias("text")))), lambda x: x["text"]), " ")
    return folded.select(*by, "i", F.trim(text).alias("text"), (total(lambda x: x["h"]) / F.size("_l")).alias("height"), (total(lambda x: x["cy"]) / F.size("_l")).alias("center_y"), F.array_min(F.transform("_l", lambda x: x["y"])).alias("top"), (total(lambda x: x["conf"].cast("double")) / F.size("_l")).alias("conf"))


def merge_title(lines: DataFrame, by: list[str]) -> DataFrame:
    """The title line (by, i, text, height, top, is_title) with its neighbours: joined down, then up, while they have letters, are no
    byline, are within 35 % of the title's height, and within 2.5 of it from the line before."""
    w = W.partitionBy(*by).orderBy("i")
    title = lines.filter("is_title").groupBy(*by).agg(F.min("i").alias("_t"), F.min_by("height", "i").alias("_th"))
    rows = lines.join(title, by)
    fit = F.col("text").rlike(r"\p{L}") & ~F.trim("text").rlike(BYLINE) & (F.abs(F.col("height") / F.col("_th") - 1) <= 0.35)
    gap = lambda other: (F.abs(F.col("top") - other["top"]) - F.greatest(F.col("height"), other["height"])) <= 2.5 * F.col("_th")
    me = F.struct("top", "height")
    down = F.when(F.col("i") > F.col("_t"), fit & gap(F.lag(me).over(w)))
    up = F.when(F.col("i") < F.col("_t"), fit & gap(F.lead(me).over(w)))
    marked = rows.withColumn("_ok", F.coalesce(down, up, F.col("i") == F.col("_t")))
    broken = lambda side: F.count_if(~F.col("_ok") & side)
    below, above = W.partitionBy(*by).orderBy("i"), W.partitionBy(*by).orderBy(F.col("i").desc())
    kept = marked.withColumns({"_b": broken(F.col("i") > F.col("_t")).over(below), "_a": broken(F.col("i") < F.col("_t")).over(above)})
    inside = kept.filter(F.when(F.col("i") >= F.col("_t"), F.col("_b") == 0).otherwise(F.col("_a") == 0))
    return inside.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: F.trim(s["text"])), " ").alias("title"))


def parse_creators(text: Column) -> Column:
    """``A B; C`` to structs (first, last): the last word is the surname."""
    names = F.filter(F.transform(F.split(text, ";"), lambda s: F.trim(s)), lambda s: s != "")
    def one(n):
        words = F.split(n, r"\s+")
        return F.struct(F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("first"), F.element_at(words, -1).alias("last"))
    return F.transform(names, one)


def sanitize(text: Column) -> Column:
    """Fit for a file name: illegal and control characters and runs of space are one space; no dots or space at the ends."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f/\\:*?\"<>|]", " "), r"\s+", " ")
    return F.regexp_replace(plain, r"^[. ]+|[. ]+$", "")


def pdf_name(authors: Column, title: Column, year: Column, fallback: Column, most: int = 120) -> Column:
    """``Authors - Title (Year).pdf``; without a title the fallback's name, without any ``output``."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    full = F.concat(F.when(has(authors), F.concat(F.trim(authors), F.lit(" - "))).otherwise(""), F.trim(title), F.when(has(year), F.concat(F.lit(" ("), F.trim(year), F.lit(")"))).otherwise(""))
    base = F.rtrim(F.left(sanitize(F.when(has(title), full).otherwise(F.coalesce(fallback, F.lit("")))), F.lit(most)))
    return F.concat(F.when(base == "", "output").otherwise(base), F.lit(".pdf"))


def duration(ms: Column) -> Column:
    """Milliseconds as ``x.x s``, ``m m s s (total s)`` or ``h h m m (total s)``."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    sec = ((t - t % 1000) / 1000).cast("long")
    return (
        F.when(t < 60_000, F.concat(F.round(t / 1000.0, 1).cast("string"), F.lit(" s")))
        .when(t < 3_600_000, F.concat_ws(" ", (sec / 60).cast("long").cast("string"), F.lit("m"), (sec % 60).cast("string"), F.lit("s"), F.concat(F.lit("("), sec.cast("string"), F.lit(" s)"))))
        .otherwise(F.concat_ws(" ", (sec / 3600).cast("long").cast("string"), F.lit("h"), ((sec % 3600) / 60).cast("long").cast("string"), F.lit("m"), F.concat(F.lit("("), sec.cast("string"), F.lit(" s)"))))
    )


def ocr_metrics(words: DataFrame, by: list[str], page_area: str | None = None) -> DataFrame:
    """Of each page's words (by, seq, text, conf, w, h): count, characters, mean and least confidence, unsure words, a hash of the text, and the covered share."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\x1f")
    area = [] if page_area is None else [(F.sum(F.col("w") * F.col("h")) / F.max(page_area)).alias("area_share")]
    return words.groupBy(*by).agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.length("text")).alias("n_chars"), F.avg("conf").alias("mean_conf"), F.min("conf").alias("min_conf"), F.count_if(F.col("conf") < 0.5).alias("n_unsure"), F.sha2(text, 256).alias("text_sha256"), *area)


def full_text(words: DataFrame, by: list[str]) -> DataFrame:
    return words.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("text"))


def guess_metadata(pages: DataFrame, by: list[str], n: int = 8) -> DataFrame:
    """Year and ISBN of a book from its pages (by, pos, text): the first year of the first ``n`` pages; of the first and last ``n`` the
    first ISBN-13, else the last ISBN-10."""
    many = F.count(F.lit(1)).over(W.partitionBy(*by))
    rows = pages.withColumns({"_k": F.row_number().over(W.partitionBy(*by).orderBy("pos")), "_n": many, "_isbn": find_isbn(F.col("text")), "_year": find_year(F.col("text"))})
    head = F.col("_k") <= n
    inside = head | (F.col("_k") > F.col("_n") - n)
    thirteen = F.length("_isbn") == 13
    return rows.groupBy(*by).agg(
        F.min_by("_year", F.when(head & F.col("_year").isNotNull(), F.col("_k"))).alias("year"),
        F.coalesce(F.min_by("_isbn", F.when(inside & thirteen, F.col("_k"))), F.max_by("_isbn", F.when(inside & ~thirteen, F.col("_k")))).alias("isbn"))


def parse_open_record(json: Column) -> Column:
    """A catalogue record in JSON to title, publisher, year and authors; missing fields are empty."""
    r = F.from_json(json, "title string, subtitle string, publishers array<struct<name:string>>, publish_date string, authors array<struct<name:string>>")
    joined = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x["name"]), "; ")
    title = F.concat_ws(": ", F.nullif(r["title"], F.lit("")), F.nullif(r["subtitle"], F.lit("")))
    return F.struct(title.alias("title"), joined(r["publishers"]).alias("publisher"), F.coalesce(find_year(r["publish_date"]), F.lit("")).alias("year"), joined(r["authors"]).alias("authors"))
