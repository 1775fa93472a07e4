"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each document gets a 60-bit hash of its id. Tokens are summed by source and by the leading bits of
the hash; the running sums tell in which bucket a source's budget ends. Only the documents of that
bucket are looked at again, with the next bits, until the budget ends at a single hash. A document is
in the mix when its hash is under its source's threshold: no sort, no join of documents with each
other. Thresholds are nested: a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_staged, free_names, id_hash, range_parts, stage, sums_before, word_count

#: Fixed values of the mix: weights by source in code-point order, repeating; share of all sizes; most passes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: Bits of the hash and bits that each histogram adds.
HASH_BITS, STEP_BITS = 60, 10


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: a share of all sizes, split by weight, at most ``passes`` times a source.

    The excess over that goes to the other sources by weight until none is above. Each round is one
    small aggregate of the sources table; only three sums come to the driver. Sources of size 0 get 0.
    """
    parts = range_parts(sources, ["source"], "mix-sources")
    total = parts.agg(F.sum("source_size")).first()[0] or 0
    ranked = parts.join(F.broadcast(sums_before(parts, _before=F.lit(1))), "_part")
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(passes) * F.col("source_size")
    rows = stage(ranked.select("source", "source_size", weight.alias("_weight"), cap.alias("_cap")), "mix-weights")
    drop_staged(parts)
    budget = min(share, passes) * total
    level = 0.0
    while budget:  # the budget never exceeds passes * total, so an uncapped source is left until all are full
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        capped, free = rows.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))).first()
        after = (budget - capped) / free if free else float("inf")
        if after <= level or not free:
            break
        level = after
    if not total:
        level = 0.0
    target = F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_weight"))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """By source the whole passes over it (``_full``) and the hash (``_cut``) under which a document is taken once more.

    ``sized`` has _source, _size and _hash. Documents with the same hash stand or fall together. The
    last hash is in or out, whichever brings the source nearer to its target.
    """
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    open_ = stage(targets.select("source", "source_size", "target", full.alias("_full")).withColumns({"_left": F.col("target") - F.col("_full") * F.col("source_size"), "_cut": F.lit(0).cast("long"), "_open": F.col("target") > F.col("_full") * F.col("source_size")}), "mix-open")
    done = open_.filter(~F.col("_open"))
    open_ = open_.filter("_open")
    finished = [done.select("source", "source_size", "target", "_full", "_cut")]
    shift = HASH_BITS
    while shift > 0:
        shift -= STEP_BITS
        # of each open source only the documents in its boundary bucket; at first that is all of them
        inside = sized.join(open_, F.col("_source").eqNullSafe(F.col("source")) & (F.shiftright(F.col("_hash"), shift + STEP_BITS) == F.shiftright(F.col("_cut"), shift + STEP_BITS)))
        histogram = inside.groupBy("source", F.shiftright(F.col("_hash"), shift).alias("_bucket")).agg(
            F.sum("_size").alias("_tokens"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most"),
            *[F.first(c).alias(c) for c in ("source_size", "target", "_full", "_left")])
        by = W.partitionBy("source").orderBy("_bucket")  # 1024 buckets of a source at most
        upto = histogram.withColumn("_upto", F.sum("_tokens").over(by))
        # the first bucket that reaches the budget; the sum of all buckets of a boundary does so by construction
        edge = upto.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_tokens") < F.col("_left")))
        before = F.col("_left") - (F.col("_upto") - F.col("_tokens"))
        edge = stage(edge.select("source", "source_size", "target", "_full", "_least", "_most", "_bucket", "_tokens", before.alias("_left")), "mix-edge")
        single = F.col("_least") == F.col("_most")
        last = edge.filter(single if shift else F.lit(True))
        take = F.col("_tokens") - F.col("_left") <= F.col("_left")
        finished.append(last.select("source", "source_size", "target", "_full", (F.when(take, F.col("_most") + 1).otherwise(F.col("_least"))).alias("_cut")))
        if not shift:
            break
        open_ = edge.filter(~single).withColumn("_cut", F.shiftleft(F.col("_bucket"), shift))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, finished)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Mix all of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, and copies (times taken).

    Null or empty texts have size 0 and take 0 words. A null source is a source of its own, the last.
    A null id hashes as the text 'null'; rows that share an id share their fate. No rows, no result.
    """
    sized = stage(docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), id_hash(F.col("doc_id")).alias("_hash")), "mix-sizes")
    sums = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    cuts = thresholds(sized, source_targets(sums, weights, share, passes))
    copies = F.col("_full") + F.when(F.col("_hash") < F.col("_cut"), 1).otherwise(0)
    taken = sized.join(cuts, F.col("_source").eqNullSafe(F.col("source")))
    return taken.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (copies * F.col("_size")).alias("taken"), copies.alias("copies"))


def draw(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken, none, once or more; all columns as they are."""
    hashed = id_hash(F.col("doc_id"))
    sized = stage(docs.select(F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), hashed.alias("_hash")), "mix-sizes")
    sums = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    cuts = thresholds(sized, source_targets(sums, weights, share, passes))
    source, full, cut, copy = free_names(docs, "_fl_source", "_fl_full", "_fl_cut", "_fl_copy")
    cuts = stage(cuts.select(F.col("source").alias(source), F.col("_full").alias(full), F.col("_cut").alias(cut)), "mix-cuts")
    copies = (F.col(full) + F.when(hashed < F.col(cut), 1).otherwise(0)).cast("int")
    taken = docs.join(cuts, F.col("source").eqNullSafe(F.col(source)))
    return taken.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies)).alias(copy)).drop(copy)
