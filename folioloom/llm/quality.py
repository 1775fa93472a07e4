"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text is counted once. The rates of the counts go into sketches: histograms over log-linear bins
(whole numbers below 32 exactly, above that 16 bins an octave) by language and source, which merge by
adding. A group's quartiles are drawn towards those of its language, and these towards those of all texts,
the more the fewer texts it has. The fences they give, one row a group, are joined to the counts and decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, stage

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_stutters long"
NAMES = [x.split()[0] for x in COUNTS.split(", ")]
SYMBOLS = "#*$%&|<>"
SPAN = 8
#: Texts that the quartiles a group is drawn to count for; quartile distances beyond the outer quartiles.
LEAST, REACH = 200, 4
#: Of each rate: numerator, denominator, scale, and the slack added to a fence, in scaled units.
RATES = {
    "word_length": ("word_chars", "n_words", 1000, 1000),
    "symbols": ("n_symbols", "word_chars", 100000, 5000),
    "dup_lines": ("n_dup_lines", "n_lines", 100000, 50000),
    "repeats": ("n_repeat_words", "n_words", 100000, 25000),
    "capitals": ("n_capitals", "word_chars", 100000, 25000),
    "stutters": ("n_stutters", "n_words", 100000, 15000),
}


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


_CAPITALS = bytes(range(65, 91))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def repeated_words(h: np.ndarray, span: int = SPAN) -> int:
    """Words (as hashes) that lie in a window of ``span`` words found twice or more in the text."""
    n = len(h) - span + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        x = np.zeros(n, np.uint64)
        for i in range(span):
            x = (x ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + span, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of a text: words, their characters, symbols, repeated lines, repeated words, lines with a word,
    ASCII capitals, and words equal to the one before."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    h = hashes(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\f\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h), len(lines), len(raw) - len(raw.translate(None, _CAPITALS)), int((h[1:] == h[:-1]).sum())


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; a null text counts as empty."""
    attach(docs.sparkSession)
    some = docs.select("doc_id", "lang", "source", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(NAMES))
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), *[pa.array(found[:, i]) for i in range(len(NAMES))]], names=["doc_id", "lang", "source", *NAMES])

    kinds = dict(some.dtypes)
    return some.mapInArrow(of, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, source {kinds['source']}, {COUNTS}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rate(name: str) -> Column:
    """A rate as a whole number; 0 where there is nothing to divide by."""
    top, bottom, scale, _ = RATES[name]
    return F.expr(f"case when {bottom} > 0 then ({top} * {scale}L) div {bottom} else 0L end")


def sketch_bin(value: str) -> Column:
    """The log-linear bin of a whole number, by integer arithmetic."""
    up = f"greatest(length(bin({value})) - 5, 0)"
    return F.expr(f"cast({up} * 16 + shiftright({value}, {up}) as int)")


def bin_top(b: str) -> Column:
    """The largest whole number of a bin."""
    up = f"greatest({b} div 16 - 1, 0)"
    return F.expr(f"case when {b} < 32 then cast({b} as long) else shiftleft(cast({b} % 16 + 17 as long), cast({up} as int)) - 1 end")


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n) of texts that pass the base rules: a few hundred rows for each group."""
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), rate(k).alias("value")) for k in RATES])
    values = counted.filter(~base_failed()).select("lang", "source", F.explode(rates).alias("r")).select("lang", "source", "r.*")
    return values.groupBy("lang", "source", "rate", sketch_bin("value").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged by ``keys``: by rate the outer quartiles and the number of texts."""
    merged = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    all_ = W.partitionBy(*keys, "rate")
    run = merged.withColumns({"_upto": F.sum("n").over(all_.orderBy("bin")), "_all": F.sum("n").over(all_), "_top": bin_top("bin")})
    quart = lambda q: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col("_top"))).cast("double")
    return run.groupBy(*keys, "rate").agg(quart(1).alias("q1"), quart(3).alias("q3"), F.max("_all").cast("double").alias("texts"))


def drawn(own: DataFrame, parent: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Quartiles of ``own`` as means with those of ``parent`` (by ``keys`` and rate), weighted by own texts and ``least``."""
    up = parent.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "rate", "q1", "q3")])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "rate")]
    mean = lambda q: (F.col("texts") * F.col(q) + F.lit(float(least)) * F.col(f"_{q}")) / (F.col("texts") + F.lit(float(least)))
    return own.join(up, same).select(*[c for c in own.columns if c not in ("q1", "q3")], mean("q1").alias("q1"), mean("q3").alias("q3"))


def fences(sketch: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """By language and source, a column for each rate: its lower and upper fence."""
    langs = drawn(quartiles(sketch, ["lang"]), quartiles(sketch, []), [], least)
    found = drawn(quartiles(sketch, ["lang", "source"]), langs, ["lang"], least)
    slack = F.element_at(F.create_map(*[F.lit(x) for k, v in RATES.items() for x in (k, v[3])]), F.col("rate"))
    wide = F.lit(reach) * (F.col("q3") - F.col("q1")) + slack
    fenced = found.select("lang", "source", "rate", F.struct((F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high")).alias("f"))
    return fenced.groupBy("lang", "source").pivot("rate", list(RATES)).agg(F.first("f"))


def judge(counted: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """``counted`` with base_failed and kept.

    A text is dropped when a rate is above its group's upper fence; a word length also below the lower
    one. Null languages and sources are groups like any other. Only texts that fail the base rules can be
    in a group without fences, as all others are in its sketch. An empty table gives no rows.
    """
    sketch = stage(sketches(counted), "quality-sketches")
    own = fences(sketch, least, reach).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[F.col(k).alias(f"_{k}") for k in RATES])
    rows = counted.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("lang", "source")], "left")
    bad = F.lit(False)
    for k in RATES:
        bad = bad | F.coalesce(rate(k) > F.col(f"_{k}.high"), F.lit(False))
    bad = bad | F.coalesce(rate("word_length") < F.col("_word_length.low"), F.lit(False))
    failed = base_failed()
    return rows.select(*counted.columns, failed.alias("base_failed"), (~failed & ~bad).alias("kept"))


def rules(docs: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text, lang, source); see judge()."""
    return judge(stage(counts(docs), "quality-counts"), least, reach)
