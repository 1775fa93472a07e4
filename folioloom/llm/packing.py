"""Best-fit packing under conflicts.

Texts longer than a bin are cut: whole bins of their own, and a rest. The rests are dealt at random into
groups of bounded size, each packed in one task, largest first. Bins are kept in the order of what
room is left; each carries a bitmap of the sources and one of the duplicate clusters in it. A rest
goes to the tightest bin that has room and neither its source's nor its cluster's bit: the search starts
at the first bin with room and goes on to its successors until one is compatible, else it opens a bin.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stage, word_count

#: Bins looked at together while searching successors.
BLOCK = 256


def _numbers(values: list) -> tuple[np.ndarray, int]:
    seen: dict = {}
    return np.array([seen.setdefault(v, len(seen)) for v in values], np.int64), len(seen)


def best_fit(sizes: np.ndarray, sources: list, clusters: list, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each item. Items go by size, the largest first, then in their order.

    A null source or cluster conflicts with nothing. Sizes are from 1 to ``capacity``.
    """
    n = len(sizes)
    bins, offsets = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    kinds = []
    for values in (sources, clusters):
        number, count = _numbers(values)
        often = np.bincount(number, minlength=count) > 1  # who comes once can't conflict
        often &= np.array([v is not None for v in dict.fromkeys(values)], bool)
        bit = np.where(often, np.cumsum(often) - 1, -1)[number]
        kinds.append((bit, np.zeros((n, max(1, -(-int(often.sum()) // 64))), np.uint64)))
    order, opened = np.lexsort((np.arange(n), -sizes)), 0
    keys, held = np.zeros(n + 1, np.int64), 0  # room << 32 | bin, ascending
    for item in order:
        size, at, found = int(sizes[item]), 0, -1
        marks = [(maps, bit[item] >> 6, np.uint64(1) << np.uint64(bit[item] & 63)) for bit, maps in kinds if bit[item] >= 0]
        at = int(np.searchsorted(keys[:held], size << 32))
        while at < held:
            some = keys[at : min(held, at + BLOCK)] & 0xFFFFFFFF
            clash = np.zeros(len(some), bool)
            for maps, word, mask in marks:
                clash |= (maps[some, word] & mask) != 0
            free = int(clash.argmin())
            if not clash[free]:
                at, found = at + free, int(some[free])
                break
            at += len(some)
        if found < 0:
            found, room, opened = opened, capacity, opened + 1
        else:
            room = int(keys[at] >> 32)
            keys[at : held - 1] = keys[at + 1 : held]
            held -= 1
        bins[item], offsets[item] = found, capacity - room
        for maps, word, mask in marks:
            maps[found, word] |= mask
        if room > size:
            key = (room - size) << 32 | found
            at = int(np.searchsorted(keys[:held], key))
            keys[at + 1 : held + 1] = keys[at:held].copy()
            keys[at] = key
            held += 1
    return bins, offsets


def pack(docs: DataFrame, cluster: Column | None = None, capacity: int = 2048, per_group: int = 16384) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text, source) into bins of ``capacity`` words.

    A text has its words and one for its end, so that empty and null texts take 1. Two rests in a bin
    have neither a source nor a duplicate cluster in common; ``cluster`` is by default the text itself.
    A null source conflicts with none. Rows that repeat are packed each for itself, and conflict. Returns
    one row for each piece: doc_id, piece, word_start, size, bin, offset. An empty table gives no rows.
    """
    attach(docs.sparkSession)
    copy = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256) if cluster is None else cluster.cast("string")
    rows = docs.select("doc_id", "source", copy.alias("cluster"), (word_count(F.col("text")) + 1).alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "pack-rows")
    left = (F.col("size") % capacity).alias("size")
    whole = F.expr(f"size div {capacity}")
    own = rows.filter(f"size >= {capacity}").select("doc_id", "row", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece"))
    own = own.select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("word_start"), F.lit(capacity).cast("long").alias("size"), F.concat_ws("-", F.lit("whole"), "row", "piece").alias("bin"), F.lit(0).cast("long").alias("offset"))
    rests = rows.filter(f"size % {capacity} > 0")
    groups = max(1, math.ceil(rests.count() / per_group))

    def fill(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_numpy()
        order = np.argsort(table["row"].to_numpy(), kind="stable")  # whatever order the rows came in
        table, sizes = table.take(order), sizes[order]
        bins, offsets = best_fit(sizes, table["source"].to_pylist(), table["cluster"].to_pylist(), capacity)
        return pa.table({"row": table["row"], "bin": pa.array(bins, pa.int32()), "offset": pa.array(offsets, pa.int64()), "doc_id": table["doc_id"], "piece": table["piece"], "size": table["size"], "group": table["group"]})

    dealt = rests.select("row", "doc_id", "source", "cluster", left, whole.cast("int").alias("piece"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"))
    kind = dict(dealt.dtypes)["doc_id"]
    packed = dealt.groupBy("group").applyInArrow(fill, f"row long, bin int, offset long, doc_id {kind}, piece int, size long, group int")
    packed = packed.select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("word_start"), "size", F.concat_ws("-", "group", "bin").alias("bin"), "offset")
    return own.unionByName(packed)
