"""Sharding: best-fit-decreasing bin packing of indivisible groups.

A group is all rows of one text; its size is the sum of its rows' sizes. Groups go, largest first, into the bin with the least remaining
capacity that still holds them, found in a balanced tree of (remaining, bin); where none holds it, a bin is opened. The packing itself runs over
size classes (size, how many groups), so that it needs no list of groups: as long as a bin is the tightest, further groups of one
size go into it, so one step places a whole run of them. Classes are exact up to 8191 and then keep 13 significant bits, rounded up; that
bounds their number at some 220,000, whatever the data. Groups then look their run up by class and rank within the class; ranks and slots
are counted in two levels (hash bucket, then within it), so that no class or shard is gathered in one task.

For a fixed number of shards, the capacity is the least for which the packing needs no more bins. A group larger than the fair share of
what is left gets a shard of its own first, for else it would set the capacity of all.

Defined results: a null text has no bytes and is grouped with empty texts. Repeated rows are rows like any other, of the same group. With
an empty table there are no rows. Rows of one doc_id and text are interchangeable, so which of them gets which slot is open.
Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


class _Leaf:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


class BalancedTree:
    """A height-balanced search tree of (remaining, bin)."""

    def __init__(self):
        self.root: _Leaf | None = None

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def ceiling(self, size: int) -> tuple[int, int] | None:
        """The least key whose remaining capacity is at least size."""
        at, best = self.root, None
        while at:
            if at.key[0] >= size:
                best, at = at.key, at.left
            else:
                at = at.right
        return best

    @staticmethod
    def _high(n: _Leaf | None) -> int:
        return n.height if n else 0

    def _mend(self, n: _Leaf) -> _Leaf:
        lean = self._high(n.left) - self._high(n.right)
        if lean > 1:
            if self._high(n.left.left) < self._high(n.left.right):
                n.left = self._turn_left(n.left)
            return self._turn_right(n)
        if lean < -1:
            if self._high(n.right.right) < self._high(n.right.left):
                n.right = self._turn_right(n.right)
            return self._turn_left(n)
        n.height = 1 + max(self._high(n.left), self._high(n.right))
        return n

    def _turn_left(self, n: _Leaf) -> _Leaf:
        up = n.right
        n.right, up.left = up.left, n
        for x in (n, up):
            x.height = 1 + max(self._high(x.left), self._high(x.right))
        return up

    def _turn_right(self, n: _Leaf) -> _Leaf:
        up = n.left
        n.left, up.right = up.right, n
        for x in (n, up):
            x.height = 1 + max(self._high(x.left), self._high(x.right))
        return up

    def _insert(self, n: _Leaf | None, key: tuple[int, int]) -> _Leaf:
        if n is None:
            return _Leaf(key)
        if key < n.key:
            n.left = self._insert(n.left, key)
        else:
            n.right = self._insert(n.right, key)
        return self._mend(n)

    def _remove(self, n: _Leaf | None, key: tuple[int, int]) -> _Leaf | None:
        if n is None:
            return None
        if key == n.key:
            if n.left is None or n.right is None:
                return n.left or n.right
            low = n.right
            while low.left:
                low = low.left
            n.key = low.key
            n.right = self._remove(n.right, low.key)
        elif key < n.key:
            n.left = self._remove(n.left, key)
        else:
            n.right = self._remove(n.right, key)
        return self._mend(n)


Run = tuple[int, int, int, int]  # size class, first rank, rank after the last, bin


def pack(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[Run] | None:
    """Best fit decreasing over (size, count); None if it would need more than `most` bins, or if a size exceeds the capacity."""
    tree, bins, runs = BalancedTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        if size > capacity:
            return None
        placed = 0
        while placed < count:
            spot = tree.ceiling(size)
            if spot is None:
                if bins == most:
                    return None
                spot, bins = (capacity, bins), bins + 1
            else:
                tree.remove(spot)
            room, at = spot
            k = min(count - placed, room // size) if size else count - placed
            runs.append((size, placed, placed + k, at))
            placed += k
            tree.insert((room - k * size, at))
    return runs


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[Run]:
    """The packing into a fixed number of shards, with the least capacity that a binary search finds."""
    left = sorted(sizes, reverse=True)
    total, own, runs = sum(s * n for s, n in left), 0, []
    at: dict[int, int] = {}  # ranks of a class that are placed already
    while left and shards - own > 1 and left[0][0] * (shards - own) > total:
        size, count = left[0]
        runs.append((size, at.get(size, 0), at.get(size, 0) + 1, own))
        at[size] = at.get(size, 0) + 1
        own, total = own + 1, total - size
        left = [(size, count - 1), *left[1:]] if count > 1 else left[1:]
    if not left:
        return runs
    bins = shards - own
    low = max(-(-total // bins), left[0][0])
    high, found = low + left[0][0], None
    while low < high:
        middle = (low + high) // 2
        trial = pack(left, middle, bins)
        if trial is None:
            low = middle + 1
        else:
            high, found = middle, trial
    if found is None:
        found = pack(left, high, bins)
    return runs + [(s, a + at.get(s, 0), b + at.get(s, 0), k + own) for s, a, b, k in found]


def _class(size):
    """size, or from 8192 on size rounded up to 13 significant bits."""
    return F.expr(f"shiftleft(shiftright({size} + shiftleft(1L, greatest(length(bin({size})) - 13, 0)) - 1, greatest(length(bin({size})) - 13, 0)), greatest(length(bin({size})) - 13, 0))")


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key): size in UTF-8 bytes plus 16; key: the text's digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))


def assign(docs: DataFrame, shards: int = 40, spread: int = 64, max_runs: int = 500_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    rows = materialise(spark, rows_of(docs), "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size")).select("key", _class("size").alias("class"), F.pmod(F.xxhash64("key"), F.lit(spread)).alias("bucket"))
    groups = materialise(spark, groups, "shard-groups")
    counts = groups.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    sizes = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count("*").alias("n")).collect()]  # bounded: see above
    runs = spark.createDataFrame(pack_into(sizes, shards), "class long, first long, after long, shard int")
    runs = F.broadcast(runs) if len(sizes) + shards <= max_runs else runs
    before = counts.select("class", "bucket", (F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("key")) - 1
    ranked = groups.withColumn("rank", rank).join(before, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(runs, (ranked["class"] == runs["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))).select("key", "shard")
    dealt = rows.join(placed, "key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(4 * spread)).alias("bucket"))
    dealt = materialise(spark, dealt, "shard-dealt")
    held = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # at most shards * 4 * spread rows
    base = held.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return (
        dealt.withColumn("within", within)
        .join(F.broadcast(base), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
