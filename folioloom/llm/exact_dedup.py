"""Exact dedup against history by a minimal perfect hash.

The index of history has one row for each bucket of digests: a minimal perfect hash (levels of bits; a
key sits at the first level where no other key fell on its bit, and the rank of that bit is its slot)
and, in slot order, the full digests with the locators of the rows that stay and the group sizes. A
digest that isn't in the index still gets a slot, so its bytes are compared with those in the slot.
Members join their history's group; nonmembers form groups of their own. Buckets have a bounded number
of digests whatever the size of a group of copies, as rows are combined by digest before they move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, by_group, free_names, stage

INDEX = "bucket int, n_keys long, levels array<int>, bits binary, left binary, digests binary, ids binary, rows binary, counts binary"
GROUPS = "digest binary, keep_id long, keep_row long, group_size long, in_history boolean"
#: Bits a level has for each key that reaches it; levels at most. Keys left then are kept in a list.
GAMMA, LEVELS = 2, 40
#: How a null id is held in the index: below any other.
NO_ID = np.iinfo(np.int64).min


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct digests (n x 32 bytes): level sizes, their bits, the indices left over, the slot of each key."""
    words = digests[:, :8].copy().view("<u8")[:, 0]
    todo, sizes, bits, placed, base = np.arange(len(words)), [], [], [], 0
    while len(todo) and len(sizes) < LEVELS:
        size = GAMMA * len(todo)
        at = (_mix(words[todo], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        placed.append((base + at[own], todo[own]))
        sizes.append(size), bits.append(alone)
        todo, base = todo[~own], base + size
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank, slots = np.cumsum(flat) - 1, np.empty(len(words), np.int64)
    for at, keys in placed:
        slots[keys] = rank[at]
    slots[todo] = int(flat.sum()) + np.arange(len(todo))
    return sizes, flat, todo, slots


def find_slots(digests: np.ndarray, sizes: list[int], flat: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The slot a digest has if it is a member; the caller compares the bytes. -1: no slot."""
    words = digests[:, :8].copy().view("<u8")[:, 0]
    rank, slots, todo, base = np.cumsum(flat) - 1, np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + (_mix(words[todo], level) % np.uint64(size)).astype(np.int64)
        hit = flat[at]
        slots[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + size
    if len(left):
        extra = {d.tobytes(): int(flat.sum()) + i for i, d in enumerate(left)}
        for k in todo:
            slots[k] = extra.get(digests[k].tobytes(), -1)
    return slots


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _longs(column, missing: int = 0) -> np.ndarray:
    return column.combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def keys(docs: DataFrame) -> DataFrame:
    """Of each row the id, the sha256 of its text in UTF-8 (null: empty text), and a row number; staged, so that numbers stay."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "dedup-keys")


def combine(rows: DataFrame) -> DataFrame:
    """Rows combined by digest before they move: the largest id, its row, and the number of rows."""
    best = F.max(F.struct(F.coalesce(F.col("doc_id"), F.lit(int(NO_ID))).alias("id"), (-F.col("row")).alias("r")))
    return rows.groupBy("digest").agg(best.alias("_b"), F.count(F.lit(1)).alias("n")).select("digest", F.col("_b.id").alias("id"), (-F.col("_b.r")).alias("row"), "n")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index over the distinct digests of ``history`` (digest, id, row, n)."""
    attach(history.sparkSession)

    def build(group: pa.Table) -> pa.Table:
        digests = _matrix(group["digest"])
        sizes, flat, left, slots = build_hash(digests)
        order = np.argsort(slots)
        pick = lambda name: [_longs(group[name])[order].tobytes()]
        return pa.table({
            "bucket": pa.array([group["bucket"][0].as_py()], pa.int32()), "n_keys": pa.array([len(digests)], pa.int64()), "levels": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([np.packbits(flat).tobytes()], pa.binary()),
            "left": pa.array([digests[left].tobytes()], pa.binary()), "digests": pa.array([digests[order].tobytes()], pa.binary()), "ids": pa.array(pick("id"), pa.binary()), "rows": pa.array(pick("row"), pa.binary()), "counts": pa.array(pick("n"), pa.binary()),
        })

    return history.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(build, INDEX)


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def look_up(batch: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Groups of history and of ``batch`` (digest, id, row, n) together, one row for each digest."""

    def merge(new: pa.Table, old: pa.Table) -> pa.Table:
        digests = _matrix(new["digest"]) if new.num_rows else np.zeros((0, 32), np.uint8)
        ids, rows, counts = (_longs(new[k]) if new.num_rows else np.zeros(0, np.int64) for k in ("id", "row", "n"))
        member = np.zeros(len(digests), bool)
        held, parts = np.zeros((0, 32), np.uint8), (np.zeros(0, np.int64),) * 3
        if old.num_rows:
            entry = old.to_pylist()[0]
            held = np.frombuffer(entry["digests"], np.uint8).reshape(-1, 32)
            parts = tuple(np.frombuffer(entry[k], "<i8").copy() for k in ("ids", "rows", "counts"))
            flat = np.unpackbits(np.frombuffer(entry["bits"], np.uint8)).astype(bool)[: sum(entry["levels"])]
            slots = find_slots(digests, entry["levels"], flat, np.frombuffer(entry["left"], np.uint8).reshape(-1, 32))
            member = slots >= 0
            member[member] = (held[slots[member]] == digests[member]).all(1)  # the full digest decides
            at = slots[member]  # digests of the batch are distinct, and so are their slots
            newer = (ids[member] > parts[0][at]) | ((ids[member] == parts[0][at]) & (rows[member] < parts[1][at]))
            parts[0][at[newer]], parts[1][at[newer]] = ids[member][newer], rows[member][newer]
            parts[2][at] += counts[member]
        other = ~member
        all_ids = np.concatenate([parts[0], ids[other]])
        return pa.table({
            "digest": pa.array([d.tobytes() for d in np.concatenate([held, digests[other]])], pa.binary()), "keep_id": pa.array(all_ids, pa.int64(), mask=all_ids == NO_ID), "keep_row": pa.array(np.concatenate([parts[1], rows[other]]), pa.int64()),
            "group_size": pa.array(np.concatenate([parts[2], counts[other]]), pa.int64()), "in_history": pa.array(np.arange(len(all_ids)) < len(held), pa.bool_()),
        })

    attach(batch.sparkSession)
    return batch.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(merge, GROUPS)


def dedup(history: DataFrame, batch: DataFrame, keys_per_bucket: int = 16384) -> DataFrame:
    """Groups of equal texts of history and batch, both as from keys(): digest, keep_id, keep_row, group_size, in_history."""
    old, new = stage(combine(history), "dedup-old"), stage(combine(batch), "dedup-new")
    buckets = max(1, math.ceil((old.count() + new.count()) / keys_per_bucket))
    index = stage(build_index(old, buckets), "dedup-index")
    return stage(look_up(new, index, buckets), "dedup-groups")


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, as a history (the lower ids, null ones too) and the batch that came after."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit((low + high) // 2 if low is not None else 0)
    return rows.filter(F.col("doc_id").isNull() | (F.col("doc_id") <= middle)), rows.filter(F.col("doc_id") > middle)


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with the group of its digest."""
    found = by_group(rows, groups.select("digest", "keep_id", "keep_row", F.col("group_size").alias("n")), ["digest"])
    return found.withColumnRenamed("n", "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), dropped ones too.

    Of equal texts the row with the largest doc_id stays (null ids are smallest; of rows with the same
    id the first read). Null and empty texts are equal. An empty table gives no rows. Returns doc_id,
    keep_id, group_size, kept, text_sha256.
    """
    rows = keys(docs)
    groups = dedup(*halves(rows))
    out = with_groups(rows, groups)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id has; all columns as they are."""
    rows = keys(docs)
    out = stage(with_groups(rows, dedup(*halves(rows))).select("doc_id", "digest", (F.col("row") == F.col("keep_row")).alias("kept")), "dedup-marks")
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    own_id, own_digest = free_names(docs, "_fl_id", "_fl_digest")
    pair = [F.col(own_id).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(own_digest) == key)]
    named = lambda df: df.select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest))
    per = out.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = named(per.filter("not kept"))
    left = docs.join(gone.hint("shuffle_hash"), pair, "left_anti")
    twice = stage(named(per.filter("kept and n > 1")), "dedup-twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, pair, "left_semi").withColumn(own_digest, key).dropDuplicates(["doc_id", own_digest]).drop(own_digest)
    return left.join(twice, pair, "left_anti").unionByName(once)
