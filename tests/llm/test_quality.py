import random
import re
from collections import Counter

from folioloom.llm import quality as Q

from .helpers import clashing, docs, empty, odd, table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    capitals, stutters = len(re.findall("[A-Z]", text)), sum(a == b for a, b in zip(words, words[1:], strict=False))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines), capitals, stutters


def test_counts():
    rng = random.Random(0)
    texts = ["", None, "a", "a\nb\na\n \na", "x\u00a0y z\x1cq", "é 🙂 ###", " ".join("ab" * 20), "A b B B É É", "one two " * 9]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert Q.measure(t) == brute(t)


def test_sketch_bins(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 1000, 123456, 10**9]
    got = spark.createDataFrame([(v,) for v in values], "value long").select("value", Q.sketch_bin("value").alias("b")).select("value", "b", Q.bin_top("b").alias("top")).collect()
    for r in got:
        assert r.value <= r.top <= r.value * 1.07
    assert [r.b for r in got] == sorted(r.b for r in got)


def rows_of(n, junk):
    rng = random.Random(1)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(40)]
        if i % 10 == 0 and junk:
            words = [w + "###" for w in words]
        out.append((i, " ".join(words), "en", f"s{i % 2}", 0))
    return out


def test_junk_goes_and_clean_stays(spark):
    got = Q.rules(clashing(table(spark, rows_of(900, True)))).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got)
    assert all(r.kept for r in Q.rules(table(spark, rows_of(300, False)), least=50).collect())


def test_small_groups_take_merged_sketches(spark):
    rows = [(i, t, lang, f"source{i}", n) for i, t, lang, _, n in rows_of(600, True)]
    got = Q.rules(table(spark, rows)).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got)


def test_quartiles_are_drawn_to_the_parent(spark):
    """Against a plain computation, with a large group, a small one and one of a single text."""
    rng = random.Random(4)
    rows = []
    for i in range(500):
        lang, source, longest = ("en", "big", 6) if i < 400 else ("en", "small", 14) if i < 499 else ("de", None, 25)
        rows.append((i, " ".join("x" * rng.randint(2, longest) for _ in range(30)) + " !", lang, source, 0))
    counted = Q.counts(table(spark, rows)).cache()
    texts = counted.collect()

    def top(v):
        up = max(len(bin(v)) - 2 - 5, 0)
        return ((v >> up) + 1 << up) - 1 if up else v

    def quart(some, q):
        values = sorted(top(r.word_chars * 1000 // r.n_words) for r in some if not (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words))
        return values[-(-len(values) * q // 4) - 1], len(values)

    def drawn(some, parent):
        return [((n := quart(some, q)[1]) * quart(some, q)[0] + Q.LEAST * p) / (n + Q.LEAST) for q, p in zip((1, 3), parent, strict=True)]

    every = drawn(texts, [quart(texts, q)[0] for q in (1, 3)])
    assert every == [quart(texts, q)[0] for q in (1, 3)]
    got = {(r.lang, r.source): r.word_length for r in Q.fences(Q.sketches(counted)).collect()}
    for lang, source in (("en", "big"), ("en", "small"), ("de", None)):
        low, high = drawn([r for r in texts if (r.lang, r.source) == (lang, source)], drawn([r for r in texts if r.lang == lang], every))
        wide = Q.REACH * (high - low) + Q.RATES["word_length"][3]
        assert abs(got[lang, source].low - (low - wide)) < 1e-6 and abs(got[lang, source].high - (high + wide)) < 1e-6


def test_odd_rows(spark):
    df = odd(spark)
    got = Q.rules(clashing(df), least=1).collect()
    assert len(got) == df.count()
    assert all(not r.kept for r in got if r.base_failed)
    want = Counter((r.doc_id, *brute(r.text)[:5]) for r in df.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert Q.rules(empty(spark)).count() == 0
    assert Q.rules(docs(spark, [None, ""])).filter("kept").count() == 0
