import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folioloom.llm import jaccard as J

from .helpers import clashing, docs, empty, odd


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    """Component of each id by comparing all pairs; rows that share an id are one node."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed, n=120):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice("abcdefgh")
            texts.append(" ".join(words + ["tail"] * rng.randint(0, 2)))
        else:
            texts.append(" ".join(str(rng.randint(0, 400)) for _ in range(rng.randint(1, 90))))
    return texts


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_against_all_pairs(spark, seed, n, percent):
    texts = corpus(seed)
    got = {r.doc_id: r for r in J.join(docs(spark, texts), n, percent).collect()}
    want = brute(list(enumerate(texts)), n, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(texts[i], n)) for i, r in got.items())
    assert len(set(want.values())) < len(want)


def test_odd_rows(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = J.join(clashing(df), 3, 90).collect()
    assert len(got) == len(rows)
    want = brute(rows, 3, 90)
    for r in got:
        if r.n_shingles and r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
        else:
            assert r.component_id == r.doc_id
    assert J.join(empty(spark)).count() == 0


def test_group_of_near_copies_needs_few_pairs(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(300)]
    df = docs(spark, texts)
    found = J.join(df, 3, 90)
    assert {r.component_id for r in found.collect()} == {0}
    ids = df.selectExpr("doc_id as id", "text")
    rows = J.describe(ids, 3, 90, J.frequencies(ids, 3))
    assert J.first_pairs(J.shared_tokens(J.prefix_rows(rows)), 90).count() < 40 * 300  # all pairs are 44850


def test_salted_shingles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(J, "SALTED", 8)  # few rows a task
    monkeypatch.setattr(J, "EACH", 3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(100)] + corpus(9, 60)
    ids = docs(spark, texts).selectExpr("doc_id as id", "text")
    frequency = J.frequencies(ids, 3)
    drawn = J.describe(ids, 3, 90, frequency).selectExpr("explode(salt) as salt").groupBy().agg({"salt": "max"}).first()[0]
    assert drawn > 3
    got = {r.doc_id: r for r in J.join(docs(spark, texts), 3, 90, links=True).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute(list(enumerate(texts)), 3, 90)
    assert [got[i].n_links for i in range(len(texts))] == brute_links(texts, 3, 90)


def test_sets_and_verification():
    rng = random.Random(8)
    texts = [None, "", " ", "a", "A b", " a  b c ", "A b\tc\nd", "é ü 🙂 x y", " \n", "x" * 70] + ["".join(rng.choice("ab \n\tC") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for n in (1, 3, 5):
        seen = {}
        column = pa.array(texts)
        for t, s in zip(texts, J.shingle_sets(column, n), strict=True):
            assert len(s) == len(shingles(t, n)) and seen.setdefault(s.tobytes(), shingles(t, n)) == shingles(t, n)
        assert len(seen) == len({shingles(t, n) for t in texts})
        assert all((s == t).all() for s, t in zip(J.shingle_sets(column.slice(5, 40), n), [J.shingle_set(t, n) for t in texts[5:45]], strict=True))
        for _ in range(500):
            a, b = rng.choice(texts) or "", rng.choice(texts) or ""
            b = rng.choice((b, a + " q", "c " + a))
            s, t = shingles(a, n), shingles(b, n)
            assert J.similar(a, b, n, 60) == (bool(s) and bool(t) and 100 * len(s & t) >= 60 * len(s | t))


def test_filters_lose_nothing():
    rng = np.random.default_rng(5)
    frequency = rng.integers(0, 5, J.BUCKETS)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common):
            pa = J.rare_first(a, frequency)[: J.prefix_length(len(a), 90)]
            pb = J.rare_first(b, frequency)[: J.prefix_length(len(b), 90)]
            assert len(np.intersect1d(pa, pb))
            assert common >= J.overlap_needed(len(a), len(b), 90)
            flips = sum(int(x).bit_count() for x in (J.parities(a) ^ J.parities(b)).view(np.uint64))
            assert flips <= len(a) + len(b) - 2 * common


@pytest.mark.parametrize("most", [4, 1 << 18])
def test_components(spark, most):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(30)]
    got = {r.id: r.root for r in J.components(spark.createDataFrame(links, "a long, b long"), most).collect()}
    root = defaultdict(lambda: None)
    for a, b in links:
        root[a], root[b] = root[a] or a, root[b] or b
    changed = True
    best = {x: x for e in links for x in e}
    while changed:
        changed = False
        for a, b in links:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                changed = True
    assert got == {k: v for k, v in best.items() if any(a != b and k in (a, b) for a, b in links)}


def test_keep_one(spark):
    texts = corpus(4, 60)
    df = clashing(docs(spark, texts))
    left = J.keep_one(df, 3, 90)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(brute(list(enumerate(texts)), 3, 90).values()))
    assert J.keep_one(odd(spark), 3, 90).count() > 0
    assert J.keep_one(empty(spark)).count() == 0


def brute_links(texts, n, percent):
    """Of each text with how many other sets its set is linked."""
    sets = {shingles(t, n) for t in texts} - {frozenset()}
    linked = {s: sum(s != t and 100 * len(s & t) >= percent * len(s | t) for t in sets) for s in sets}
    return [linked.get(shingles(t, n), 0) for t in texts]


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)  # many blocks
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(60)] + [" ".join(base)] * 3 + corpus(6, 80) + ["", None]
    want = brute_links(texts, 3, 90)
    got = {r.doc_id: r for r in J.join(docs(spark, texts), 3, 90, links=True).collect()}
    assert [got[i].n_links for i in range(len(texts))] == want
    assert min(want[:63]) == 60  # a dense group has all its pairs
    assert {r.n_links for r in J.join(odd(spark), 3, 90, links=True).collect()} == {0}
    assert J.join(empty(spark), links=True).count() == 0
