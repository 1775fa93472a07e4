import random
from collections import defaultdict

import numpy as np

from folioloom.llm import packing as P

from .helpers import LONG, clashing, docs, empty, odd, table


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, where = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= sizes[i] and sources[i] not in b["s"] and clusters[i] not in b["c"]]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        where[i] = (k, capacity - bins[k]["room"])
        bins[k]["room"] -= sizes[i]
        bins[k]["s"] |= {sources[i]} - {None}
        bins[k]["c"] |= {clusters[i]} - {None}
    return [where[i] for i in range(len(sizes))]


def test_against_plain_best_fit():
    rng = random.Random(2)
    for case in range(25):
        n = rng.randint(1, 400)
        sizes = np.array([rng.randint(1, 100) for _ in range(n)])
        sources = [rng.choice([None, *range(200 if case % 2 else 6)]) for _ in range(n)]
        clusters = [rng.choice([None, *range(n)]) for _ in range(n)]
        bins, offsets = P.best_fit(sizes, sources, clusters, 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == plain_best_fit(sizes, sources, clusters, 100)


def check(rows, df, capacity):
    by_bin, by_doc = defaultdict(list), defaultdict(int)
    for r in rows:
        by_bin[r.bin].append(r)
        by_doc[r.doc_id] += r.size
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert sum(r.size for r in own) <= capacity
        assert all(a.offset + a.size == b.offset for a, b in zip(own, own[1:], strict=False))
    want = defaultdict(int)
    for r in df.collect():
        want[r.doc_id] += len((r.text or "").encode().split()) + 1
    assert by_doc == want


def test_rows(spark):
    df = odd(spark)
    rows = P.pack(clashing(df), capacity=64).collect()
    check(rows, df, 64)
    assert any(r.word_start >= 64 for r in rows if r.doc_id == 5)
    assert P.pack(empty(spark)).count() == 0


def test_conflicts_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 50)), "en", f"s{min(i % 30, 9)}", 0) for i in range(600)]
    df = table(spark, rows)
    packed = P.pack(df, capacity=64, per_group=100).collect()
    check(packed, df, 64)
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    by_bin = defaultdict(list)
    for r in packed:
        by_bin[r.bin].append(r.doc_id)
    for own in by_bin.values():
        assert len({source[i] for i in own}) == len(own) == len({text[i] for i in own})
    assert sorted(map(tuple, packed)) == sorted(map(tuple, P.pack(df, capacity=64, per_group=100).collect()))


def test_long_text(spark):
    df = docs(spark, [LONG], ids=[5])
    rows = P.pack(df, capacity=1000).collect()
    check(rows, df, 1000)
    assert len({r.bin for r in rows}) == len(rows) == 61
