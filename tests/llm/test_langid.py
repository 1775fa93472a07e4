import random

import pytest

from folioloom.llm import langid as L

from .helpers import clashing, empty, odd, table

PARTS = {"xx": ["tion", "ing", "the", "and", "est"], "yy": ["schö", "ung", "ein", "der", "keit"], "zz": ["eau", "que", "les", "ment", "oir"]}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 120))]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), lang, "s", 0))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600, 1)
    df = table(spark, rows)
    learned = L.learn(df.filter("doc_id < 400"), sample=50)
    assert sorted(learned) == sorted(PARTS)
    assert all(len(v) <= L.DICTIONARY for v in learned.values())
    got = {r.doc_id: r for r in L.identify(clashing(df), learned).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, _, _ in rows if i >= 400) >= 190
    assert all(0 <= r.score <= 1 for r in got.values())


def test_same_as_a_plain_compressor(spark):
    import zstandard

    df = table(spark, corpus(150, 3))
    learned = L.learn(df.filter("doc_id < 100"), sample=50)

    def plain(text):
        sizes = {}
        for lang, content in learned.items():
            one = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
            sizes[lang] = len(one.compress(L.letters(text)))
        best, second = sorted(sizes.values())[:2]
        return min(k for k, v in sizes.items() if v == best), (second - best) / best

    text = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: (r.lang_pred, r.margin) for r in L.identify(df, learned).collect()}
    assert got == {i: plain(t) for i, t in text.items()}


def test_odd_rows(spark):
    df = odd(spark)
    got = L.identify(df, L.learn(df)).collect()
    assert len(got) == df.count()
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "fr", "und") for r in got)
    assert L.identify(empty(spark), {}).count() == 0
    assert {r.lang_pred for r in L.identify(df, L.learn(empty(spark))).collect()} == {"und"}


def test_narrow_margins_are_rejected():
    c = L.Classifier({"a": b"the same words", "b": b"the same words"})
    lang, score, margin = c.classify("the same words")
    assert (lang, margin) == ("a", 0.0) and score == 0.5
    assert L.Classifier({"a": b"x"}).classify("some text")[0] == "a"


def test_too_many_languages(spark):
    rows = [(i, "text", f"l{i}", "s", 4) for i in range(L.LANGUAGES + 1)]
    with pytest.raises(ValueError, match="languages"):
        L.learn(table(spark, rows))


def test_more_languages_than_a_block(spark, monkeypatch):
    df = table(spark, corpus(120, 2))
    whole = L.learn_all(df)
    want = sorted(L.identify(df, whole).collect())
    monkeypatch.setattr(L, "LANGUAGES", 2)
    parts = L.learn_all(df)
    assert parts == whole and sorted(L.identify(df, parts).collect()) == want
    monkeypatch.undo()
    rows = [(i, f"text of l{i}", f"l{i}", "s", 4) for i in range(L.LANGUAGES + 1)]
    many = table(spark, rows)
    found = L.learn_all(many)
    assert len(found) == len(rows)
    assert L.identify(many.filter("doc_id < 5"), found).count() == 5


def test_every_sampled_text_teaches(spark):
    rows = [(i, f"head{i} " * 300 + f"tail{i} " * 300, "xx", "s", 0) for i in range(30)] + [(99, "short", "xx", "s", 5)]
    (made,) = L.learn(table(spark, rows), sample=1000, size=6000).values()
    assert 5000 < len(made) <= 6000 and b"short" in made
    parts = made.split(b"\n")
    assert len(parts) == 31
    assert any(b"tail" in x for x in parts) and any(b"head" in x for x in parts)  # places from all of a text


def test_spans():
    raw = "aä bö cü dß".encode() * 40
    for draw in range(200):
        some = L.span(raw, 50, draw)
        assert 0 < len(some) <= 50 and some in raw and some.decode()
    assert L.span(b"abc", 3, 7) == b"abc"
    assert L.shared_out([5, 5, 100], 60) == 50 and L.shared_out([1, 2], 60) == 2 and L.shared_out([], 9) == 0
