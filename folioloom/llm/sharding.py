"""Contiguous shards of equal bytes from global prefix sums. DataFrame functions only.

Rows are range-partitioned by id and each partition is summed on its own. The running sum of the
partition totals (one row for each partition) turns sums within a partition into global offsets, and
a row goes to the shard in whose equal share of all bytes its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_staged, range_parts, stage, sums_before


def measured(docs: DataFrame) -> DataFrame:
    """Of each row the id, the bytes of its text in UTF-8 plus 1, and their crc32; a null text counts as empty."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put all rows, in ascending doc_id, into ``shards`` contiguous shards of near-equal bytes.

    Null ids come last; rows with equal ids are ordered by crc32 and size, and equal rows are alike.
    A row longer than a shard's share leaves neighbours short or empty, as rows are never cut. An
    empty table gives no rows. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    rows = stage(measured(docs), "shard-sizes")
    ranged = range_parts(rows, ["doc_id", "text_crc32", "size"], "shard-ranges")
    drop_staged(rows)
    total = ranged.agg(F.sum("size")).first()[0] or 0
    start = F.broadcast(sums_before(ranged, _bytes0=F.col("size"), _rows0=F.lit(1)))  # as many rows as range partitions
    by = W.partitionBy("_part").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    upto = F.sum("size").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    # the middle byte's share of all bytes, in whole numbers
    placed = (
        ranged.withColumns({"_upto": upto, "_nr": F.row_number().over(by).cast("long")})
        .join(start, "_part")
        .withColumns({"shard": F.expr(f"cast(least({shards - 1}, ((_bytes0 + _upto) * 2 - size) * {shards} div {max(1, 2 * total)}L) as int)"), "_at": F.col("_rows0") + F.col("_nr") - 1})
    )
    placed = stage(placed.select("doc_id", "size", "text_crc32", "shard", "_at"), "shard-placed")
    drop_staged(ranged)
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("_at").alias("_first")))  # as many rows as shards
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
