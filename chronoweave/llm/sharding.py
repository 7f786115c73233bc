"""Sharding by best-fit-decreasing bin packing.

Documents of equal text are one indivisible group.  Groups of equal size are a class; the
table of classes (size, number of groups) is all that packing needs, and it has at most
twice the root of all bytes rows, as fewer than total/s groups are larger than s.  Classes,
largest first, enter the shard with the least remaining capacity that holds them, found
in a balanced tree of shards by remaining capacity: a shard stays the tightest for groups
of one size until it holds no more of them, so a whole run of equal groups is placed in one
step, just as they would be one by one.  The capacity is the least, by bisection, at which
all groups fit in the given number of shards, which makes sizes near equal.  Groups are
then numbered within their class, and take the shard of their number.

Defined results: a null text counts as an empty one (8 bytes a row); groups of equal size
are numbered by digest; repeated rows are rows of one group; an empty table gives an empty
result.  A single group above the capacity stays whole, in a shard of its own size.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import free, save

#: Rows that one task numbers, and parts in which groups of one size are numbered.
RUN_ROWS, PARTS = 200_000, 256
OVERHEAD = 8
#: Keys in a leaf of the tree.
LEAF = 64


class Tree:
    """A balanced tree of two levels: sorted leaves of at most LEAF keys, and their greatest keys in order."""

    def __init__(self):
        self.leaves: list[list] = []
        self.tops: list = []

    def add(self, key) -> None:
        i = min(bisect.bisect_left(self.tops, key), len(self.leaves) - 1)
        if i < 0:
            self.leaves, self.tops = [[key]], [key]
            return
        leaf = self.leaves[i]
        bisect.insort(leaf, key)
        if len(leaf) > LEAF:
            self.leaves[i : i + 1] = [leaf[: LEAF // 2], leaf[LEAF // 2 :]]
            self.tops[i : i + 1] = [leaf[LEAF // 2 - 1], leaf[-1]]
        else:
            self.tops[i] = leaf[-1]

    def pop_least(self, low):
        """Take out the least key that isn't below ``low``; None if there is none."""
        i = bisect.bisect_left(self.tops, low)
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        key = leaf.pop(bisect.bisect_left(leaf, low))
        if leaf:
            self.tops[i] = leaf[-1]
        else:
            del self.leaves[i], self.tops[i]
        return key


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """(size, first, last, bin) runs of (size, number) classes, which come largest first; bins open as needed.

    A group above the capacity gets a bin of its own.  None if more than ``most`` bins are needed.
    """
    tree, out, bins = Tree(), [], 0
    for size, number in classes:
        at = 0
        while at < number:
            found = tree.pop_least((size, -1))
            if found is None:
                if bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            left, b = found
            k = min(number - at, left // size) if size else number - at
            out.append((size, at, at + k, b))
            tree.add((left - k * size, b))
            at += k
    return out


def pack(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs in bins 0 to ``shards`` - 1 at the least capacity that best-fit-decreasing makes do with."""
    total = sum(s * n for s, n in classes)
    low = max(-(-total // shards), classes[0][0] if classes else 0)
    at, step, best = low, max(1, low // 1024), None
    while best is None:
        best = best_fit_decreasing(classes, at, shards)
        low, high, at, step = (low, at, at, step) if best is not None else (at + 1, None, at + step, step * 2)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_decreasing(classes, mid, shards)
        low, high, best = (low, mid, got) if got is not None else (mid + 1, high, best)
    return best


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = save(docs.select(F.col(id_col).alias("doc_id"), (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("digest")))
    groups = save(rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(PARTS)).cast("int")))
    by_part = groups.groupBy("bytes", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(W.partitionBy("bytes").orderBy("part")) - F.col("n")).drop("n")
    classes = [tuple(r) for r in groups.groupBy("bytes").agg(F.count("*")).orderBy(F.desc("bytes")).collect()]
    runs = spark.createDataFrame(pack(classes, shards), "bytes long, first long, last long, shard int")
    number = F.row_number().over(W.partitionBy("bytes", "part").orderBy("digest")) - 1
    own = groups.withColumn("number", number).join(before, ["bytes", "part"]).withColumn("number", F.col("number") + F.col("before"))
    placing = save(own.join(runs, "bytes").where("number >= first AND number < last").select("digest", "shard"))
    placed = save(rows.join(placing, "digest").select("doc_id", "size", "text_crc32", "shard", F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")).alias("key")))
    free(rows, groups, placing)

    runs = max(1, placed.count() // (shards * RUN_ROWS) * 2 + 1)
    placed = placed.withColumn("run", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(runs * 16)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    offset = counts.select("shard", "run", (F.sum("n").over(W.partitionBy("shard").orderBy("run")) - F.col("n")).alias("offset"))
    slot = F.row_number().over(W.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    out = placed.withColumn("at", slot).join(offset, ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
