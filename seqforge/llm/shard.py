"""Sharding by minimax contiguous partition of ordered atomic groups, with DataFrame operations only.

Rows of equal texts are an atomic group. Groups stand in the order of a 64-bit hash of the text. The smallest capacity
for which a greedy walk needs no more than ``n_shards`` shards is found by binary search, and the groups are cut there.
A group larger than the mean shard left gets a shard of its own first (there can be fewer than ``n_shards`` of these), so
that one hot text does not blow up every other shard.

The walk runs on the driver over a summary whose size does not grow with the input: sums of ``2**bits`` ranges of the
hash, of which those that a cut may fall into are split again until each holds one group. Numbering inside a shard
goes by (shard, cell), where a cell is a hash of the row, so that neither a large shard nor a hot text meets in one task; the
number of cells grows with the rows.

Defined results: a null text has the size of the overhead, the CRC of the empty text, and is a group of its own with the
empty text; rows that repeat get a row and a slot each; an empty table gives no rows; null ids are numbered like others; very
long texts count by their size alone, and one above the mean shard gets a shard of its own; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqforge.session import materialise

#: The first look at the groups splits the hash space into 2**BITS ranges, each later one a range into 2**MORE_BITS.
BITS, MORE_BITS = 12, 4
#: The least number of cells of a shard, and the rows of one from which on there are more.
CELLS, CELL_ROWS = 64, 100_000


def law_bytes(sizes: list[int], n: int, capacity: int) -> list[int] | None:
    """Greedy: the indexes at which shards begin, or None if more than ``n`` are needed."""
    cuts, load = [0], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if load + size > capacity:
            cuts.append(i)
            load = 0
            if len(cuts) > n:
                return None
        load += size
    return cuts


def walk(ends: list[int], total: int, n: int, capacity: int) -> list[int] | None:
    """As :func:`law_bytes` by the running sums ``ends`` of the sizes: n looks by bisection."""
    cuts, at = [], 0
    for _ in range(n):
        cuts.append(at)
        i = bisect_right(ends, at + capacity) - 1
        reached = ends[i] if i >= 0 else 0
        if reached >= total:
            return cuts
        if reached <= at:
            return None
        at = reached
    return None


def smallest_capacity(ends: list[int], n: int) -> int:
    """The smallest capacity that :func:`walk` finds feasible."""
    total = ends[-1] if ends else 0
    low, high = -(-total // n), total
    while low < high:
        middle = (low + high) // 2
        if walk(ends, total, n, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def text_hash(text: Column) -> Column:
    """A non-negative 63-bit hash; equal texts have equal hashes, and texts that collide share a group."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


class Summary:
    """Leaves (first hash, bytes, groups, prefix, width in bits): sums over ranges of the hash, in order."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.leaves = self._split([(0, 63)], BITS)

    def _split(self, ranges: list[tuple[int, int]], bits: int) -> list[tuple[int, int, int, int, int]]:
        out = []
        for width in sorted({w for _, w in ranges}):
            left = max(0, width - bits)
            part = self.groups if width == 63 else self.groups.where(F.shiftright("h", width).isin([p for p, w in ranges if w == width]))
            out += part.groupBy(F.shiftright("h", left).alias("k")).agg(F.min("h").alias("first"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")).select("first", "bytes", "n", "k", F.lit(left)).collect()
        return sorted(tuple(r) for r in out)

    def refine(self, which: set[int]) -> None:
        finer = self._split([self.leaves[i][3:] for i in which], MORE_BITS)
        self.leaves = sorted([x for i, x in enumerate(self.leaves) if i not in which] + finer)


def plan(groups: DataFrame, n_shards: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Of ``groups`` (h, bytes): the hashes that have a shard of their own, and (first hash, shard) of the others'.

    With leaves for groups, the capacity found is feasible, so the best is no larger. At a feasible capacity c up to
    that, cut k lies between total - (n - k) * c and k * c; once the leaves there are single groups, the walk over
    leaves cuts where the walk over groups does, and the capacity found is the best.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    own: dict[int, int] = {}
    left, rest = n_shards, total
    for h, size in groups.orderBy(F.desc("bytes"), "h").limit(n_shards).collect():
        if left > 1 and size * left > rest:
            own[h] = len(own)
            left, rest = left - 1, rest - size
    summary = Summary(groups.where(~F.col("h").isin(list(own))) if own else groups)
    while summary.leaves:
        ends = list(accumulate(x[1] for x in summary.leaves))
        capacity = smallest_capacity(ends, left)
        doubtful = set()
        for k in range(1, left):
            for i in range(bisect_left(ends, rest - (left - k) * capacity), min(bisect_right(ends, k * capacity) + 1, len(ends))):
                if summary.leaves[i][2] > 1:
                    doubtful.add(i)
        if not doubtful:
            cuts = walk(ends, rest, left, capacity)
            return own, [(summary.leaves[bisect_right(ends, c) if c else 0][0], len(own) + i) for i, c in enumerate(cuts)]
        summary.refine(doubtful)
    return own, []


def shard(docs: DataFrame, n_shards: int = 24, text_col: str = "text", id_col: str = "doc_id", overhead: int = 8) -> DataFrame:
    """For each row: its id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null: by this law
    another shard moves rows between all)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialise(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), text_hash(F.col(text_col)).alias("h")),
        "sized",
    )
    groups = materialise(sized.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    own, firsts = plan(groups, n_shards)
    to = F.lit(firsts[0][1] if firsts else 0)
    for h, k in firsts[1:]:
        to = F.when(F.col("h") >= h, k).otherwise(to)
    for h, k in own.items():
        to = F.when(F.col("h") == h, k).otherwise(to)
    cells = max(CELLS, -(-sized.count() // (n_shards * CELL_ROWS)))
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)).cast("int")
    dealt = sized.select("doc_id", "size", "text_crc32", to.cast("int").alias("shard"), cell.alias("cell"))
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("i", F.row_number().over(inside) - 1)
    # the rows are dealt by (shard, cell) for the numbers already
    return numbered.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
