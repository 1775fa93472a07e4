"""Language identification by compression.

For each language a bounded sample of labelled texts becomes a zstandard raw-content dictionary. A text is
compressed as a whole with each of them, and the dictionary that makes it smallest names its language.
Where the runner-up is nearly as small the decision is marked as rejected. Only the dictionaries, of
fixed size, go to the workers. More languages than a block has are learned and compared in blocks, of
which a text keeps the two smallest sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach

#: Texts sampled for a language, in expectation; bytes of a dictionary; languages of a block; compression level.
SAMPLE, DICTIONARY, LANGUAGES, LEVEL = 400, 110 * 1024, 64, 4
#: The margin, as a share of the smallest size, below which a decision is rejected.
MARGIN = 0.01
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """What is compressed: the text in lower case, with one space for what ASCII has beside letters."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def span(raw: bytes, size: int, draw: int) -> bytes:
    """``size`` bytes of ``raw`` at most, from a place that ``draw`` picks among all of it; words are whole where there are spaces."""
    if len(raw) <= size:
        return raw
    start = draw % (len(raw) - size + 1)
    some = raw[start : start + size]
    if start and b" " in some:
        some = some[some.index(b" ") + 1 :]
    if start + size < len(raw) and b" " in some:
        some = some[: some.rindex(b" ")]
    return some


def shared_out(sizes: list[int], room: int) -> int:
    """The most that each may have so that together they don't exceed ``room``: short ones leave theirs to the others."""
    left = len(sizes)
    for size in sorted(sizes):
        if size * left > room:
            return room // left
        room, left = room - size, left - 1
    return max(sizes, default=0)


def learn(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries by language from ``docs`` (doc_id, text, lang; null languages and texts teach nothing).

    The sample of a language is taken by a hash of the ids: about ``sample`` texts however many there
    are. Each has an equal share of the dictionary, a span from a place in the whole text that a hash
    picks; what short texts leave goes to the others. Only such spans reach the driver. At most LANGUAGES
    languages, a block of them; more are an error (``learn_all`` takes any number).
    """
    attach(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null and text <> ''")
    per = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(per) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not per:
        return {}
    share = F.create_map(*[F.lit(x) for r in per for x in (r["lang"], min(1.0, sample / r["count"]))])
    most = F.create_map(*[F.lit(x) for r in per for x in (r["lang"], 4 * size // max(1, min(sample, r["count"])))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.filter(draw < share[F.col("lang")]).select("lang", F.xxhash64("doc_id", "text").alias("h"), most[F.col("lang")].alias("most"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [span(letters(t), m, h & (1 << 63) - 1) for t, m, h in zip(*[b.column(k).to_pylist() for k in ("text", "most", "h")], strict=True)]
            yield pa.record_batch([b.column("lang"), b.column("h"), pa.array(spans, pa.binary())], names=["lang", "h", "span"])

    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows.mapInArrow(cut, "lang string, h long, span binary").collect():  # about 4 * ``size`` bytes a language
        found.setdefault(r.lang, []).append((r.h, bytes(r.span)))
    out = {}
    for lang in sorted(found):
        spans = sorted(found[lang])
        fair = shared_out([len(x) + 1 for _, x in spans], size)
        out[lang] = b"\n".join(span(x, fair - 1, h & (1 << 63) - 1) for h, x in spans) if fair > 1 else b""
    return out


def learn_all(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """``learn`` for any number of languages, a block at a time."""
    names = docs.filter("lang is not null and text is not null and text <> ''").select("lang").distinct()
    langs = sorted(r.lang for r in names.collect())  # a short text a language
    if len(langs) <= LANGUAGES:
        return learn(docs, sample, size)
    found = {}
    for i in range(0, len(langs), LANGUAGES):
        found |= learn(docs.filter(F.col("lang").isin(langs[i : i + LANGUAGES])), sample, size)
    return found


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages, self.coders = sorted(dictionaries), []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_checksum=False, write_content_size=False))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and margin between the two smallest sizes as a share of the smallest."""
        return decide(self.smallest(text))

    def smallest(self, text: str | None) -> list[tuple[int, str]]:
        """The two smallest sizes with their languages, of equal ones the first by name; none for texts without letters."""
        if not self.languages or not text or not _LETTER.search(text):
            return []
        raw = letters(text)
        return sorted((len(c.compress(raw)), lang) for lang, c in zip(self.languages, self.coders, strict=True))[:2]


def decide(smallest: list[tuple[int, str]]) -> tuple[str, float, float]:
    if not smallest:
        return "und", 0.0, 0.0
    if len(smallest) == 1:
        return smallest[0][1], 1.0, 1.0
    (best, lang), (second, _) = smallest
    margin = (second - best) / best
    return lang, float(1 / (1 + np.exp(-min(50.0, 100 * margin)))), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text): doc_id, lang_pred, score, margin, accepted.

    ``und`` (score 0, not accepted) for texts that are null or have no letter, and when no language was
    learned. Equal sizes go to the language that comes first by name, and are not accepted.
    """
    attach(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # a dictionary of bounded size for each language
    langs = sorted(dictionaries)
    blocks = [langs[i : i + LANGUAGES] for i in range(0, len(langs), LANGUAGES)] or [[]]
    some = docs.select("doc_id", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = lambda block: Classifier({k: shared.value[k] for k in block})
        only = coder(blocks[0]) if len(blocks) == 1 else None  # coders are larger than dictionaries: of several blocks one is held
        for b in batches:
            texts = b.column("text").to_pylist()
            least: list[list[tuple[int, str]]] = [[] for _ in texts]
            for block in blocks:
                classifier = only or coder(block)
                least = [sorted(x + classifier.smallest(t))[:2] for x, t in zip(least, texts, strict=True)]
            found = [decide(x) for x in least]
            yield pa.record_batch([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score", "margin"])

    kind = dict(some.dtypes)["doc_id"]
    return some.mapInArrow(of, f"doc_id {kind}, lang_pred string, score double, margin double").withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("margin") >= margin))
