"""Jaccard join of texts on word n-grams by rare-first prefix filtering, and its components.

1. A pass over all texts counts, for a fixed number of hash buckets, in how many documents' sets a shingle
   of the bucket is. These counts give one global order of shingles, the rare before the common.
2. A second pass makes of each text its set's size, signature, prefix (the first shingles in that order;
   two sets over the threshold share one) and the parities of its classes under a hash (for the suffix filter).
   Equal sets become one class, represented by its smallest id.
3. The rows of each prefix shingle are ordered by size. Of shingles with few rows (EACH) all pairs are candidates, of
   the others each row with the first one and with the one before. Pairs that pass the length, positional and
   suffix filters stay. The pair of each set with its smallest candidate is verified on whole texts, and gives
   first components.
4. All other candidates whose sets are still in different components are verified, then all pairs between
   components of the shingles with many rows; links within a component change nothing. So a group of thousands
   of near copies costs a few pairs a document, and no link between components is lost.
5. Where links are to be counted, all pairs of classes of a component are compared (links never leave one),
   each pair once, in blocks of a bounded number of sets.

Shingles that the counts show to be very frequent are salted, so that no task gets all rows of one. Candidates are
found on 64-bit hashes of shingles; pairs are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, attach, by_group, drop_staged, free_names, stage

#: Hash buckets for shingle frequencies; a byte each on the workers, whatever the input.
BUCKETS = 1 << 22
#: Steps of a frequency's code in each doubling.
STEPS = 8
#: Rows of a shingle of which all pairs are candidates at once; rows of a salted shingle in a task, about.
EACH, SALTED = 8, 512
#: Hash classes of the suffix filter, a bit for each: 128 bytes a document.
CLASSES = 1024
LONGS = CLASSES // 64
#: Classes of a component that a block has, about: a worker holds the sets of two blocks.
BLOCK = 256
#: Links that one task may unite: a few MB.
UNITED = 1 << 18
#: Bytes of text that are hashed together.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in the bytes of several texts, and by text where its words end.

    A text ends where ``ends`` says, and a word never crosses that. ASCII letters count as lower case.
    """
    space = _SPACE[data]
    first = ~space
    inner = first[1:] & ~space[:-1]
    first[1:] &= ~inner
    breaks = ends[:-1][ends[:-1] < len(data)]
    first[breaks] = ~space[breaks]  # a text's first byte starts a word
    starts = np.flatnonzero(first)
    upto = np.searchsorted(starts, ends, "left")
    if not len(starts):
        return np.zeros(0, np.uint64), upto
    lens = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, lens)
    value = _BYTE[data[starts[0] :]] * _powers(int(lens.max()))[at]  # white space after a word adds 0
    return _mix(np.add.reduceat(value, starts - starts[0])), upto


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of the texts of a string column with the end of each, a bounded number of whole texts at once."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield data[ends[at] : ends[upto]], ends[at + 1 : upto + 1] - ends[at]
        at = upto


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct hashes of n-word shingles; of fewer words one for the whole sequence; of none none."""
    for data, ends in _chunks(column):
        h, upto = word_hashes(data, ends)
        # of all places at once; those in which a shingle would cross to the next text are left out
        places = max(0, len(h) - n + 1)
        x = np.full(places, n, np.uint64)
        for i in range(n):
            x = _mix((x ^ h[i : places + i]) * np.uint64(0x9E3779B97F4A7C15))
        start = 0
        for end in upto.tolist():
            if end - start >= n:
                s = np.sort(x[start : end - n + 1])
                yield s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                one = np.full(min(1, end - start), end - start, np.uint64)
                for i in range(start, end):
                    one = _mix((one ^ h[i]) * np.uint64(0x9E3779B97F4A7C15))
                yield one
            start = end


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))


def similar(a: str, b: str, n: int, percent: int) -> bool:
    """Whether the shingle sets of two texts link, by their words; texts without words don't."""
    words = [t.encode("utf-8", "replace").lower().split() for t in (a, b)]
    if min(map(len, words)) < n:
        return words[0] == words[1] and bool(words[0])
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in some], np.int64) for some in words]
    run, distinct = ids, len(number)
    for i in range(1, n):
        if distinct * len(number) >= 1 << 63:  # number the distinct runs of i words anew
            known, at = np.unique(np.concatenate(run), return_inverse=True)
            run, distinct = np.split(at, [len(run[0])]), len(known)
        run, distinct = [r[:-1] * len(number) + x[i:] for r, x in zip(run, ids, strict=True)], distinct * len(number)
    sets = [np.unique(r) for r in run]
    both = len(np.intersect1d(*sets, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least common shingles of sets of sizes a and b whose Jaccard similarity is ``percent`` hundredths or more."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as whole numbers of as few bytes as the largest needs, and that number of bytes before them."""
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4 if counts.max() < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def frequencies(texts: DataFrame, n: int) -> tuple[np.ndarray, float]:
    """By bucket the code of how many (document, distinct shingle) pairs there are, and the mean count.

    A code is STEPS times the binary logarithm of the count and 1: a byte for each bucket, so that the table
    has a fixed size. Each task counts into a table of its own, and hands it on in pieces; tasks that
    sum up pieces read them one by one, so none holds more than its part of the table.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = 1 << min(10, max(2, partitions.bit_length()))
    piece = BUCKETS // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(BUCKETS, np.uint32), [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), n):
                held.append(bucket_of(s))
                waiting += len(s)
                if waiting > CHUNK:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.uint32)
                    held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.uint32)
        for i in range(pieces):
            own = total[i * piece : (i + 1) * piece]
            if own.any():
                yield pa.record_batch({"piece": pa.array([i], pa.int32()), "counts": pa.array([_narrow(own)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(i, np.zeros(piece, np.uint64))
                own += np.frombuffer(raw, f"<u{raw[0]}", offset=1)
        for i, own in sums.items():
            code = np.minimum(255, np.round(STEPS * np.log2(own + 1.0))).astype(np.uint8)
            yield pa.record_batch({"piece": pa.array([i], pa.int32()), "codes": pa.array([code.tobytes()], pa.binary()), "total": pa.array([float(own.sum())], pa.float64())})

    summed = texts.select("text").mapInArrow(count, "piece int, counts binary").repartition(pieces, "piece").mapInArrow(add, "piece int, codes binary, total double")
    out, total = np.zeros(BUCKETS, np.uint8), 0.0
    for r in summed.toLocalIterator():  # the table, a row for each piece
        out[r.piece * piece : (r.piece + 1) * piece] = np.frombuffer(r.codes, np.uint8)
        total += r.total
    return out, total / BUCKETS


def rare_first(hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """``hashes`` (sorted) in the global order: by their bucket's frequency, then by hash."""
    return hashes[np.argsort(frequency[bucket_of(hashes)], kind="stable")]


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def salt_counts(mean: float) -> np.ndarray:
    """By a bucket's code into how many parts its shingles are split: 1 unless its count is far beyond what others add to it."""
    count = np.exp2(np.arange(256) / STEPS) - 1
    return np.maximum(1, np.ceil((count - 4 * mean) / SALTED)).astype(np.uint64)


def salts(hashes: np.ndarray, doc: int, frequency: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Of each shingle of a document its part, drawn by shingle and document; -1 of those that aren't split."""
    own = parts[frequency[bucket_of(hashes)]]
    drawn = _mix(hashes ^ np.uint64(doc & (1 << 64) - 1)) % own
    return np.where(own > 1, drawn.astype(np.int64), -1).astype(np.int32)


def parities(hashes: np.ndarray) -> np.ndarray:
    """By hash class whether the number of shingles is odd, as CLASSES / 64 longs."""
    odd = np.bincount((hashes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(values: list[np.ndarray], dtype) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype), *values])))


def describe(texts: DataFrame, n: int, percent: int, frequency: tuple[np.ndarray, float]) -> DataFrame:
    """Of each text (id, text): size of its set, signature, prefix in order and its salts, parities of its hash classes."""
    table = texts.sparkSession.sparkContext.broadcast((frequency[0], salt_counts(frequency[1])))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts = table.value
        for batch in batches:
            sizes, signs, prefixes, drawn, odd = [], [], [], [], []
            for doc, s in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                sizes.append(len(s))
                signs.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefix = rare_first(s, codes)[: prefix_length(len(s), percent)]
                prefixes.append(prefix.view(np.int64))
                drawn.append(salts(prefix, doc or 0, codes, parts))
                odd.append(parities(s))
            yield pa.record_batch({
                "id": batch.column("id"), "size": pa.array(sizes, pa.int32()), "sign": pa.array(signs, pa.binary()),
                "prefix": _lists(prefixes, np.int64), "salt": _lists(drawn, np.int32), "parity": _lists(odd, np.int64),
            })

    return texts.mapInArrow(of, "id long, size int, sign binary, prefix array<long>, salt array<int>, parity array<long>")


def _needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def _possible(a: str, b: str, percent: int) -> Column:
    """Length and positional filter on two rows (size, at) that share the shingle at those places."""
    col = lambda side, name: F.col(f"{side}.{name}")
    sa, sb, pa_, pb = col(a, "size"), col(b, "size"), col(a, "at"), col(b, "at")
    length = (F.lit(percent) * F.greatest(sa, sb)) <= F.lit(100) * F.least(sa, sb)
    return length & (F.least(pa_, pb) + 1 + F.least(sa - pa_ - 1, sb - pb - 1) >= _needed(sa, sb, percent))


def _suffix(sa: Column, sb: Column, a: Column, b: Column, percent: int) -> Column:
    """Suffix filter: a shingle that only one of two sets has changes one class's parity, so that the
    differing parities are no more than the shingles in which the sets differ."""
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(LONGS)), F.lit(0))
    return apart <= sa + sb - 2 * _needed(sa, sb, percent)


def prefix_rows(nodes: DataFrame) -> DataFrame:
    """(token, salt, id, size, at) of ``nodes`` (id, size, prefix, salt): a row for each shingle of a prefix."""
    each = F.posexplode(F.arrays_zip(F.col("prefix").alias("token"), F.col("salt").alias("salt")))
    return nodes.select("id", "size", each.alias("at", "_t")).select("_t.token", "_t.salt", "id", "size", "at")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """The rows of shingles that several sets have in their prefix, with ``others``, what each is to be paired with.

    In the order of size these are all rows before it where a shingle has EACH rows or fewer, else the first one
    and the one before. ``dense``: whether pairs are left. One shuffle; the windows hold EACH rows.
    """
    group = W.partitionBy("token", "salt")
    by = group.orderBy("size", "id")
    me = F.struct("id", "size", "at")
    near = F.collect_list(me).over(by.rowsBetween(1 - EACH, -1))
    seen = tokens.withColumns({"_n": F.count(F.lit(1)).over(group), "_near": near, "_first": F.first(me).over(by)})
    dense = (F.col("salt") >= 0) | (F.col("_n") > EACH)
    two = F.array_distinct(F.array("_first", F.element_at("_near", -1)))
    others = F.when(F.size("_near") == 0, F.lit(None)).when(dense, two).otherwise(F.col("_near"))
    return seen.filter((F.col("_n") > 1) | dense).select("token", "id", "size", "at", dense.alias("dense"), others.alias("others"))


def first_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """The pairs of shared_tokens() that pass the length and positional filters."""
    near = shared.filter(F.col("others").isNotNull()).select(F.struct("id", "size", "at").alias("me"), F.explode("others").alias("other"))
    return _ordered(near.filter(_possible("me", "other", percent)))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b of rows with structs me and other."""
    me, other = F.col("me.id"), F.col("other.id")
    return pairs.select(F.least(me, other).alias("a"), F.greatest(me, other).alias("b")).filter("a < b").distinct()


def cross_pairs(rows: DataFrame, component: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of each shingle's rows (token, id, size, at) that are in different components and pass all filters.

    Of a shingle's components the one with most rows is joined only with the rest, so a large component
    costs its rows times those outside it. All filters are conditions of the join: pairs that fail one
    never become rows. ``component`` (id, root) has the nodes that have links.
    """
    rooted = rows.join(component, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("token").agg(F.max(F.struct("n", "root")).alias("_m"), F.count(F.lit(1)).alias("_k"))
    mixed = per.filter("_k > 1").select("token", F.col("_m.root").alias("major"))
    marked = rooted.join(mixed, "token").join(nodes.select("id", "parity"), "id")
    marked = stage(marked.select("token", "root", "id", "size", "at", "parity", (F.col("root") == F.col("major")).alias("big")), "join-marked")
    side = marked.alias("me").filter("not big"), marked.alias("other")
    apart = (F.col("me.root") != F.col("other.root")) & (F.col("other.big") | (F.col("me.root") < F.col("other.root")))  # two minor components meet once
    same = F.col("me.token") == F.col("other.token")
    close = _suffix(F.col("me.size"), F.col("other.size"), F.col("me.parity"), F.col("other.parity"), percent)
    return _ordered(side[0].join(side[1], same & apart & _possible("me", "other", percent) & close))


def suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the suffix filter."""
    side = lambda k: nodes.select(F.col("id").alias(k), F.col("size").alias(f"s{k}"), F.col("parity").alias(f"p{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_suffix(F.col("sa"), F.col("sb"), F.col("pa"), F.col("pb"), percent)).select("a", "b").distinct()


def _with_texts(ids: DataFrame, most: int, texts: DataFrame) -> DataFrame:
    """The texts of ``ids`` (id), of which there are at most ``most``, once each.

    A bitmap of at most 2^24 bits, whatever the input, keeps most other texts from being shuffled.
    """
    bits = 1 << max(12, min(24, (16 * most).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    word, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    bitmap = ids.groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(id), {bits}L), 64) as int))")).alias("_bits"))
    some = texts.join(F.broadcast(bitmap), word == F.col("_word")).filter(F.getbit("_bits", bit) == 1).select("id", "text")  # 2^18 rows at most
    return some.join(ids.distinct(), "id", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the staged ``pairs`` (a, b) whose sets' Jaccard similarity is ``percent`` hundredths or more, by their words."""
    found = _with_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * pairs.count(), texts)
    side = lambda k: found.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_of = zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)
            keep = pa.array([similar(x or "", y or "", n, percent) for x, y in texts_of], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return stage(both.mapInArrow(check, "a long, b long"), "join-links")


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of links (u, v): each of their nodes with the smallest that it is connected with here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(list(map(find, nodes)), pa.int64())], names=["u", "v"])


def components(links: DataFrame, most: int = UNITED) -> DataFrame:
    """Of each node of ``links`` (a, b) its component's smallest id: (id, root).

    Links are united in tasks of about ``most`` links. What one task can't hold goes through large-star and
    small-star steps in turn, each staged; a node's neighbours meet only in a minimum and a join, so that
    no task holds them all. It ends when every link leads to a root, or when one task can hold the rest.
    """
    kind = "u long, v long"
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-edges")
    count = edges.count()
    if count > most:
        dealt = edges.repartition(-(-count // most)).mapInArrow(_unite, kind).filter("u <> v").distinct()
        edges, before = stage(dealt, "cc-united"), edges
        drop_staged(before)
        count = edges.count()
    while count > most:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small, "cc-small")
        drop_staged(edges, large)
        edges, count = after, after.count()
        # done when no node has two roots, and no root has one: sums by node of 1 for each root it has, and 2^20 for being one
        is_root = edges.select(F.col("v").alias("u")).distinct().withColumn("k", F.lit(1 << 20))
        states = edges.select("u", F.lit(1).alias("k")).unionByName(is_root).groupBy("u").agg(F.sum("k").alias("k"))
        if states.filter(~F.col("k").isin(1, 1 << 20)).isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    found = edges.coalesce(1).mapInArrow(_unite, kind)  # ``most`` links at most
    found = stage(found.select(F.col("u").alias("id"), F.col("v").alias("root")), "cc-roots")
    drop_staged(edges)
    return found


def _as_links(component: DataFrame) -> DataFrame:
    return component.select(F.col("id").alias("a"), F.col("root").alias("b"))


def link_all(texts: DataFrame, nodes: DataFrame, shared: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, root) of all nodes that have links. Each pair is verified once at most."""
    tried = stage(suffix_filter(first_pairs(shared, percent), nodes, percent), "join-pairs")
    hooks = stage(tried.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "join-hooks")
    near = components(verify(hooks, texts, words, percent))

    def with_links(near: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs, "join-more")
        return near if pairs.isEmpty() else components(_as_links(near).unionByName(verify(pairs, texts, words, percent)))

    side = lambda k: near.select(F.col("id").alias(k), F.col("root").alias(f"r{k}"))
    rooted = tried.join(hooks, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    near = with_links(near, rooted.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    across = cross_pairs(shared.filter("dense").select("token", "id", "size", "at"), near, nodes, percent)
    return with_links(near, across.join(tried, ["a", "b"], "left_anti"))


def _pairs_in(sides: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of the sets of a block (all on side 0), or of two (sides 0 and 1), each with the later or other ones it links with."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    two = sides.any()
    mark = np.zeros(len(known), np.int64)
    for i in np.flatnonzero(sides == 0) if two else range(len(sets)):
        mine = at[starts[i] : starts[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[at], starts[:-1])
        mark[mine] = 0
        close = (100 * common >= percent * (sizes + sizes[i] - common)) & ((sides == 1) if two else (np.arange(len(sets)) > i))
        yield i, np.flatnonzero(close)


def count_block(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> dict[int, int]:
    """Links by id among the sets of a block (all on side 0), or between two blocks (sides 0 and 1).

    An id may have several sets; what any of them links with counts once.
    """
    own = [i for i, s in enumerate(sets) if len(s)]
    if len(own) < 2:
        return {}
    ids, sides, sets = np.array(ids)[own], np.array(sides)[own], [sets[i] for i in own]
    names, which = np.unique(ids, return_inverse=True)
    if len(names) == len(ids):
        counts = np.zeros(len(ids), np.int64)
        for i, others in _pairs_in(sides, sets, percent):
            counts[i] += len(others)
            counts[others] += 1
        return {int(ids[i]): int(counts[i]) for i in np.flatnonzero(counts)}
    found = set()
    for i, others in _pairs_in(sides, sets, percent):
        found |= {(min(which[i], k), max(which[i], k)) for k in which[others].tolist() if k != which[i]}
    counts = np.bincount(np.array(list(found), np.int64).reshape(-1), minlength=len(names))
    return {int(names[i]): int(counts[i]) for i in np.flatnonzero(counts)}


def count_links(found: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n_links) of the nodes of the staged ``found`` (id, root): with how many others of its component each is linked.

    A component's nodes are dealt to blocks of about BLOCK, and a cell is a block, or two of them. So each
    pair meets in one cell, a text is read as often as its component has blocks, and only counts leave a cell.
    """
    blocks = found.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("k"))
    some = _with_texts(found.select("id"), found.count(), texts)
    rows = some.distinct().join(found, "id").join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    met = rows.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = met.select("root", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"), (F.col("block") > F.col("met")).cast("int").alias("side"), "id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [], [])

        def done() -> pa.RecordBatch:
            links = count_block(*held, percent)
            return pa.record_batch({"id": pa.array(list(links), pa.int64()), "n_links": pa.array(list(links.values()), pa.int64())})

        for batch in batches:
            ready = []
            keys = zip(*[batch.column(k).to_pylist() for k in ("root", "i", "j")], strict=True)
            for key, doc, side, own in zip(keys, batch.column("id").to_pylist(), batch.column("side").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                if cell != key:
                    if len(held[0]) > 1:
                        ready.append(done())
                    cell, held = key, ([], [], [])
                for column, x in zip(held, (doc, side, own), strict=True):
                    column.append(x)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
        if len(held[0]) > 1:
            yield done()

    dealt = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(count, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def join(docs: DataFrame, words: int = 3, percent: int = 90, links: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id.

    With ``links`` also n_links: with how many other classes the row's class is linked, all of them counted.

    Texts are compared by their sets of distinct ``words``-word shingles, ASCII letters in lower case.
    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest reachable by links.
    Texts without words, and null ones, have an empty set and are linked with nothing: both are their own
    id. Rows that share an id are one node: what either links to, both do. A null id links nothing, and
    its class and component are null. An empty table gives no rows.
    """
    attach(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    sets = stage(describe(texts, words, percent, frequencies(texts, words)), "join-sets")
    rows = sets.select("id", F.col("size").cast("long").alias("size"), "sign")
    real = rows.filter("size > 0 and id is not null")
    classes = sets.filter("size > 0 and id is not null").groupBy("sign", "size")
    firsts = [F.first(c).alias(c) for c in ("prefix", "salt", "parity")]
    nodes = stage(classes.agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *firsts), "join-nodes")
    shared = stage(shared_tokens(prefix_rows(nodes)), "join-shared")
    found = link_all(texts, nodes, shared, words, percent)
    drop_staged(shared)
    counts = stage(count_links(found, texts, words, percent), "join-counts") if links else None
    reps = nodes.select("sign", F.col("size").cast("long").alias("size"), "n", F.col("id").alias("rep"))
    twice = real.groupBy("id").count().filter("count > 1").select("id")
    if not twice.isEmpty():  # rows that share an id but not a text
        marked = real.join(twice, "id", "left_semi").join(reps, ["sign", "size"])
        several = marked.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.collect_set("rep").alias("reps")).filter("lo < hi")
        same = several.select(F.col("lo").alias("a"), F.explode("reps").alias("b")).filter("a < b")
        found = components(_as_links(found).unionByName(same))
    roots = reps.join(found, reps["rep"] == found["id"], "left").select("sign", "size", "n", "rep", F.coalesce("root", "rep").alias("root"))
    if links:
        roots = roots.join(counts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    more = ["n_links"] if links else []
    out = by_group(real, roots, ["sign", "size"])
    alone = rows.filter("size = 0 or id is null").select("id", "size", F.col("id").alias("rep"), F.col("id").alias("root"), *[F.lit(0).cast("long").alias(k) for k in more])
    every = out.select("id", "size", "rep", "root", *more).unionByName(alone)
    return every.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("rep").alias("class_id"), F.col("root").alias("component_id"), *more)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of near duplicates, that with the smallest id; all columns as they are.

    Of rows that share that id one stays. Rows without words, or without an id, all stay.
    """
    (own,) = free_names(docs, "_fl_id")
    marks = join(docs, words, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    left = docs.join(marks.hint("shuffle_hash"), docs["doc_id"] == F.col(own), "left_anti")
    twice = stage(docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(WORD)).groupBy(F.col("doc_id").alias(own)).count().filter("count > 1").select(own), "join-twice")
    if twice.isEmpty():
        return left
    has = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    again = left.join(twice, left["doc_id"] == F.col(own), "left_semi")
    once = again.filter(has).dropDuplicates(["doc_id"])
    return left.join(twice, left["doc_id"] == F.col(own), "left_anti").unionByName(once).unionByName(again.filter(~has))
