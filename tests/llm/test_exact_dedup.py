import hashlib
from collections import defaultdict

import numpy as np

from folioloom.llm import exact_dedup as X

from .helpers import clashing, docs, empty, odd, sha


def test_hash_is_minimal_perfect_and_bytes_decide():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    sizes, flat, left, slots = X.build_hash(digests[:4000])
    assert sorted(slots) == list(range(4000))
    assert (X.find_slots(digests[:4000], sizes, flat, digests[left]) == slots).all()
    strange = X.find_slots(digests[4000:], sizes, flat, digests[left])
    held = digests[:4000][np.argsort(slots)]
    assert not (held[strange[strange >= 0]] == digests[4000:][strange >= 0]).all(1).any()


def test_keys_alike_to_the_hash_are_left_over_and_found():
    twins = np.zeros((3, 32), np.uint8)
    twins[:, 31] = [1, 2, 3]
    sizes, flat, left, slots = X.build_hash(twins)
    assert sorted(slots) == [0, 1, 2]
    assert (X.find_slots(twins, sizes, flat, twins[left]) == slots).all()


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_odd_rows(spark):
    df = odd(spark)
    want = brute(df.collect())
    got = X.exact_dedup(clashing(df)).collect()
    assert len(got) == df.count()
    by_sha = {sha(t): v for t, v in want.items()}
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    for key in by_sha:
        assert sum(r.kept for r in got if r.text_sha256 == key) == 1
    assert X.exact_dedup(empty(spark)).count() == 0


def test_history_and_batch(spark):
    old, new = docs(spark, ["a", "b", "b"]), docs(spark, ["b", "c", "c", ""], ids=[10, 11, 12, 13])
    groups = {r.digest.hex(): r for r in X.dedup(X.keys(old), X.keys(new), keys_per_bucket=2).collect()}
    assert {k: (r.keep_id, r.group_size, r.in_history) for k, r in groups.items()} == {sha("a"): (0, 1, True), sha("b"): (10, 3, True), sha("c"): (12, 2, False), sha(""): (13, 1, False)}


def test_hot_group(spark):
    df = docs(spark, ["hot"] * 3000 + [f"t{i}" for i in range(50)])
    got = X.exact_dedup(df).collect()
    assert sum(r.kept for r in got) == 51
    assert {r.keep_id for r in got if r.group_size == 3000} == {2999}


def test_keep_one(spark):
    df = odd(spark)
    left = X.keep_one(clashing(df))
    assert left.columns == clashing(df).columns
    rows = left.collect()
    assert len(rows) == len(brute(df.collect()))
    assert {r.text or "" for r in rows} == set(brute(df.collect()))
    assert X.keep_one(empty(spark)).count() == 0
