import random

import numpy as np

from folioloom.llm import toxicity as T

from .helpers import clashing, docs, empty, odd, table

CLEAN = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "to", "ni", "su", "pe", "xa")]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vileword", "grimstem" + rng.choice(CLEAN)])
        rows.append((i, " ".join(words), "en" if i % 3 else "de", int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    df = table(spark, [(i, t, lang, "s", len(t)) for i, t, lang, _ in rows])
    labels = spark.createDataFrame([(i, bad) for i, _, _, bad in rows if i < 700], "doc_id long, toxic int")
    model = T.train(df, labels)
    got = {r.doc_id: r for r in T.score(clashing(df), model).collect()}
    wrong = sum(got[i].predicted != bad for i, _, _, bad in rows if i >= 700)
    assert wrong <= 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    left = T.clean(clashing(df), model)
    assert left.columns == clashing(df).columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}


def test_scan_matches_training_features():
    """The cached scan over words gives what the training step's plain convolution gives."""
    rows = corpus(200, 2)
    model = T.fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    for text in ("", "one", "two words", rows[0][1], rows[1][1]):
        rows_of = model.row[T.buckets_of(text.encode().split())]
        _, x = T._features(model, [rows_of])
        assert np.isclose(float(x[0] @ model.weight + model.offset), model.logit(text)[0], atol=1e-4)


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(odd(spark), none)
    got = T.score(odd(spark), model).collect()
    assert len(got) == odd(spark).count()
    assert all(r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, 0), (7, None)], "doc_id long, toxic int")
    assert T.score(odd(spark), T.train(odd(spark), some)).count() == odd(spark).count()
    assert T.score(empty(spark), model).count() == 0
    assert T.clean(empty(spark), model).count() == 0


def test_words_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 4)
    words = T.Words(T.buckets_of, T.PARTS, np.int32)
    for text in ("a b c", "d e f", "a b c d e f g h i"):
        assert (words.of(text) == T.buckets_of(text.encode().split())).all()
