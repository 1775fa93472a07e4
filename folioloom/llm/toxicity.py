"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to rows of an embedding table; filters of several widths run over the whole text, the
largest value of each filter is pooled, and a linear layer gives a logit. It is trained with Adagrad on a
bounded sample of labelled texts. A language is guessed from the text by hashed word counts; on a
fold of the sample that wasn't trained on, each language gets the logit at which its errors
balance, and scores are shifted so that this point is 0.5. The model has a fixed size and is broadcast.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach

#: Labelled texts to fit on, at most, of each label; their bytes, about; bytes of the longest that is drawn.
SAMPLE, SAMPLE_BYTES, LONGEST = 3000, 16 << 20, 1 << 20
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 12, (1, 2, 3), 8
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.05, 1e-4
#: Texts of the sample a bucket must be in to get an embedding; toxic texts that weigh as much in a language's threshold as all languages' do.
LEAST, OWN = 8, 25
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of the two beginnings of a word that are hashed beside it; words whose features a worker keeps.
STEMS, CACHE = (4, 5), 300_000
PARTS = 1 + len(STEMS)


class Words:
    """Numbers distinct words and keeps a value for each; full, it starts anew before the next text."""

    def __init__(self, value_of, width: int, dtype):
        self.value_of, self.known, self.values = value_of, {}, np.zeros((CACHE, width), dtype)

    def of(self, text: str | None) -> np.ndarray:
        """The values of the text's words, in order."""
        words = (text or "").encode("utf-8", "replace").split()
        known = self.known
        new = list({w for w in words if w not in known})
        if len(known) + len(new) > len(self.values):
            known.clear()
            new = list(set(words))
            if len(new) > len(self.values):
                self.values = np.zeros((2 * len(new), self.values.shape[1]), self.values.dtype)
        if new:
            at = len(known)
            self.values[at : at + len(new)] = self.value_of(new)
            known.update(zip(new, range(at, at + len(new)), strict=True))
        return self.values[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def buckets_of(words: list[bytes]) -> np.ndarray:
    """Hash buckets of words and of their beginnings; ASCII letters in lower case, punctuation at the ends off."""
    crc, out = zlib.crc32, []
    for word in words:
        w = word.lower().strip(_STRIP)
        out.append((crc(w), *[crc(w[:k], k) for k in STEMS]))
    return (np.array(out, np.int64).reshape(-1, PARTS) & (BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    """``row``: bucket to embedding, 0 for none. ``log_odds``: languages by hashed words, for the guess."""

    row: np.ndarray
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float
    languages: list[str] = field(default_factory=list)
    log_odds: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    default: float = 0.0
    _words: Words | None = None

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def _values(self, words: list[bytes]) -> np.ndarray:
        """Of each word its share of each filter's value at each place in the filter, then its language log-odds."""
        b = buckets_of(words)
        e = self.embedding[self.row[b]].sum(1)
        taps = [e @ self.filters[w][k] for w in WIDTHS for k in range(w)]
        return np.concatenate([*taps, *([self.log_odds[b[:, 0]]] if self.languages else [])], 1)

    def logit(self, text: str | None) -> tuple[float, int]:
        """The logit, and the index of the guessed language, -1 without words or languages.

        The largest value of each filter over the whole text is pooled, at least 0; short texts are padded.
        """
        if self._words is None:
            self._words = Words(self._values, sum(WIDTHS) * FILTERS + len(self.languages), np.float32)
        x, out, at = self._words.of(text), [], 0
        for w in WIDTHS:
            n = max(1, len(x) - w + 1)
            value = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                tap = x[k : k + n, at : at + FILTERS]
                value[: len(tap)] += tap
                at += FILTERS
            out.append(np.maximum(value.max(0) + self.bias[w], 0))
        lang = int(x[:, at:].sum(0).argmax()) if len(x) and self.languages else -1
        return float(np.concatenate(out) @ self.weight + self.offset), lang

    def score(self, text: str | None) -> float:
        logit, lang = self.logit(text)
        at = self.default if lang < 0 else self.thresholds[lang]
        return float(1 / (1 + np.exp(np.clip(at - logit, -30, 30))))


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        total = self.seen.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        if rows is None:
            total += grad * grad
            value -= self.rate * grad / np.sqrt(total)
        else:
            total[rows] += grad * grad
            value[rows] -= self.rate * grad / np.sqrt(total[rows])


def _features(model: Model, docs: list[np.ndarray]) -> tuple[dict, np.ndarray]:
    """Pooled values of a batch of texts (words x PARTS rows), and the words each comes from, for the gradient."""
    where, pooled = {}, []
    embedded = [model.embedding[d].sum(1) for d in docs]
    for w in WIDTHS:
        lens = np.array([max(1, len(d) - w + 1) for d in docs])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        value = np.zeros((lens.sum(), FILTERS), np.float32)
        for k in range(w):
            for at, n, e in zip(starts, lens, embedded, strict=True):
                tap = e[k : k + n] @ model.filters[w][k]
                value[at : at + len(tap)] += tap
        top = np.maximum.reduceat(value, starts, axis=0)
        at = np.where(value == np.repeat(top, lens, 0), np.arange(len(value))[:, None], len(value))
        first = np.minimum.reduceat(at, starts, axis=0) - starts[:, None]  # docs x filters
        rows = np.zeros((len(docs), FILTERS, w, PARTS), np.int32)
        for i, d in enumerate(docs):
            for k in range(w):
                inside = first[i] + k < len(d)
                rows[i, inside, k] = d[first[i][inside] + k]
        where[w] = rows
        pooled.append(np.maximum(top + model.bias[w], 0))
    return where, np.concatenate(pooled, 1)


def fit(texts: list[str], toxic: list[int], langs: list[str | None], rarity: float = 1.0, seed: int = 7) -> Model:
    """Train on labelled texts; every fourth one only sets the thresholds. Without both labels all logits are alike.

    ``rarity``: how many clean texts each clean one of the sample stands for, against the toxic ones.
    """
    rng = np.random.default_rng(seed)
    words = Words(buckets_of, PARTS, np.int32)
    hashed = [words.of(t) for t in texts]
    y = np.array(toxic, np.float32)
    seen = np.bincount(np.concatenate([np.unique(h) for h in hashed] or [np.zeros(0, np.int32)]), minlength=BUCKETS)
    row = np.zeros(BUCKETS, np.int32)
    often = np.flatnonzero(seen >= LEAST)
    row[often] = np.arange(1, len(often) + 1)
    scale = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    model = Model(row, scale(len(often) + 1, DIM) / 3, {w: scale(w, DIM, FILTERS) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, scale(len(WIDTHS) * FILTERS), 0.0)
    model.embedding[0] = 0
    held = np.arange(len(y)) % 4 == 3
    train = np.flatnonzero(~held)
    whole = [h[:, 0].copy() for h in hashed]
    for i in range(len(hashed)):  # in place: the sample is held once
        hashed[i] = row[hashed[i]]
    if len(y) and 0 < y[train].sum() < len(train):
        _descend(model, hashed, y, train, rng)
    else:
        model.weight[:] = 0
        model.offset = -5.0 if not y.sum() else 5.0
    _learn_languages(model, whole, langs)
    _calibrate(model, [t for t, k in zip(texts, held, strict=True) if k], y[held], rarity)
    return model


def _descend(model: Model, docs: list[np.ndarray], y: np.ndarray, train: np.ndarray, rng: np.random.Generator) -> None:
    step, share = _Adagrad(RATE), float(y[train].mean())
    offset = np.array([np.log(share / (1 - share))], np.float32)
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            where, x = _features(model, [docs[i] for i in some])
            p = 1 / (1 + np.exp(-np.clip(x @ model.weight + offset, -30, 30)))
            g = ((p - y[some]) / len(some)).astype(np.float32)
            gx = g[:, None] * model.weight * (x > 0)
            rows, grads = [], []
            for i, w in enumerate(WIDTHS):
                gw = gx[:, i * FILTERS : (i + 1) * FILTERS]
                gf = np.zeros_like(model.filters[w])
                for k in range(w):
                    e = model.embedding[where[w][:, :, k]].sum(2)  # docs x filters x dim
                    gf[k] = np.einsum("df,dfe->ef", gw, e)
                    ge = (gw[:, :, None] * model.filters[w][k].T[None]).reshape(-1, DIM)
                    rows.append(where[w][:, :, k].reshape(-1))
                    grads.append(np.repeat(ge, PARTS, 0))
                step.step(("f", w), model.filters[w], gf + DECAY * model.filters[w])
                step.step(("b", w), model.bias[w], gw.sum(0))
            step.step("w", model.weight, x.T @ g + DECAY * model.weight)
            step.step("o", offset, g.sum(keepdims=True))
            rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            total[rows == 0] = 0  # what has no row stays at zero
            step.step("e", model.embedding, total, rows)
    model.offset = float(offset[0])


def _learn_languages(model: Model, hashed: list[np.ndarray], langs: list[str | None]) -> None:
    model.languages = sorted({x for x in langs if x is not None})
    if not model.languages:
        return
    counts = np.full((BUCKETS, len(model.languages)), 0.1, np.float32)
    for h, lang in zip(hashed, langs, strict=True):
        if lang is not None:
            np.add.at(counts[:, model.languages.index(lang)], h, 1)
    odds = np.log(counts / counts.sum(0))
    model.log_odds = (odds - odds.mean(1, keepdims=True)).astype(np.float32)


def balance(logits: np.ndarray, y: np.ndarray, rarity: float = 1.0) -> float:
    """The logit at which F1 is best, midway to the next text below it; a clean text counts ``rarity`` times."""
    order = np.argsort(-logits, kind="stable")
    hits, false = np.cumsum(y[order]), rarity * np.cumsum(1 - y[order])
    f1 = 2 * hits / (hits + false + y.sum())
    best = int(f1.argmax())
    low = logits[order[best + 1]] if best + 1 < len(y) else logits[order[best]] - 2
    return float((logits[order[best]] + low) / 2)


def _calibrate(model: Model, texts: list[str], y: np.ndarray, rarity: float) -> None:
    """Thresholds by guessed language, drawn towards that of all texts where a language has few toxic ones."""
    found = [model.logit(t) for t in texts]
    logits, guess = np.array([x[0] for x in found]), np.array([x[1] for x in found], int)
    model.default = balance(logits, y, rarity) if 0 < y.sum() < len(y) else 0.0
    model.thresholds = np.full(len(model.languages), model.default)
    for i in range(len(model.languages)):
        own, n = guess == i, y[guess == i].sum()
        if 0 < n < own.sum():
            model.thresholds[i] = (n * balance(logits[own], y[own], rarity) + OWN * model.default) / (n + OWN)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled texts of each label, drawn by a hash of their ids, of about SAMPLE_BYTES bytes.

    ``docs`` (doc_id, text, lang), ``labels`` (doc_id, toxic 0/1), both as far as they may be learned from.
    Only ids are sorted. The sample goes to one task, which hands back the model; no text reaches the
    driver. Texts over LONGEST bytes aren't drawn; those drawn are read whole. Of several labels of an id
    the largest counts; null labels, ids and texts teach nothing. Without labelled texts no text is toxic.
    """
    attach(docs.sparkSession)
    per = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per = per.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    drawn = [per.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    some = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * sample ids
    size = F.octet_length("text").cast("long")
    rows = docs.filter(F.col("text").isNotNull() & (size <= LONGEST)).join(some, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "toxic")
    before = F.sum(size).over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "text").rowsBetween(W.unboundedPreceding, -1))  # 2 * sample rows
    rows = rows.withColumn("_before", before).filter(F.coalesce("_before", F.lit(0)) < SAMPLE_BYTES).drop("_before")
    size = {r.toxic: r.n for r in per.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands = lambda k: max(1.0, size.get(k, 0) / sample)
    rarity = stands(0) / stands(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {}
        for b in batches:
            for doc_id, *row in zip(*[b.column(k).to_pylist() for k in ("doc_id", "text", "lang", "toxic")], strict=True):
                chosen[doc_id] = max(chosen.get(doc_id, row), row, key=lambda r: r[0])  # of rows that share an id the last by text
        order = sorted(sorted(chosen), key=lambda k: zlib.crc32(k.encode()) ^ 0x5BD1E995)
        model = fit(*[[chosen[k][i] for k in order] for i in (0, 2, 1)], rarity)
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.repartition(1).mapInArrow(learn, "model binary").first()  # 2 * SAMPLE_BYTES of texts, about
    return pickle.loads(found.model) if found else fit([], [], [])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, score from 0 to 1, predicted (1 at 0.5 or more).

    Null and empty texts are scored like texts without a known word; an empty table gives no rows.
    """
    attach(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    some = docs.select("doc_id", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shared.value.score(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    out = some.mapInArrow(of, f"doc_id {dict(some.dtypes)['doc_id']}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic; all columns as they are, one pass, no join.

    Null and empty texts are judged like texts without a known word, ids and labels aren't looked at, rows
    that repeat share their fate, and an empty table gives no rows.
    """
    attach(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < 0.5 for t in b.column(b.schema.names.index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
