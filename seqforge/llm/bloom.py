"""Blocked Bloom filters as tables; DataFrame operations only.

A key's hash chooses a part of the filter, one 64-bit block of the part, and four bits of the block. The filter grows with
its keys (``BITS_PER_KEY`` bits each, 2 MB for a million keys); a part is a row with an array of blocks. Rows are tested by
an equi-join with the parts. It is broadcast where the filter has up to ``BROADCAST_BYTES`` (32 million keys), which its number
of parts tells beforehand; a larger filter is joined by a shuffle of the parts.

Defined results: a null key is in no filter, and a filter without keys holds nothing. There are no false negatives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.session import materialise

BITS_PER_KEY, PART_BLOCKS, BROADCAST_BYTES = 16, 1 << 16, 64 << 20


def _mask(key_hash: Column) -> Column:
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(key_hash, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


@dataclass
class Bloom:
    parts: DataFrame
    n_blocks: int

    @property
    def bytes(self) -> int:
        return 8 * self.n_blocks

    def _block(self, key_hash: Column) -> Column:
        return F.shiftrightunsigned(key_hash, 32).bitwiseAND(F.lit(self.n_blocks - 1))

    def flag(self, rows: DataFrame, key: Column, name: str = "__maybe") -> DataFrame:
        """``rows`` with a boolean column: false only where the filter was not built with the key."""
        per = min(self.n_blocks, PART_BLOCKS)
        parts = F.broadcast(self.parts) if self.bytes <= BROADCAST_BYTES else self.parts
        found = rows.withColumn("__h", F.when(key.isNotNull(), F.xxhash64(key)))
        found = found.withColumn("__own", F.floor(self._block(F.col("__h")) / per).cast("int")).join(parts, F.col("__own") == F.col("__part"), "left")
        word = F.get("__blocks", (self._block(F.col("__h")) % per).cast("int"))
        holds = F.coalesce(word.bitwiseAND(_mask(F.col("__h"))) == _mask(F.col("__h")), F.lit(False))
        return found.withColumn(name, holds).drop("__h", "__own", "__part", "__blocks")


def build(keys: DataFrame) -> Bloom:
    """The filter of the (first) column of ``keys``; keys may repeat."""
    key = F.col(keys.columns[0])
    keys = materialise(keys.select(F.xxhash64(key).alias("h")).where(key.isNotNull()).distinct(), "bloom-keys")
    n, n_blocks = keys.count(), 64
    while n_blocks * 64 < n * BITS_PER_KEY:
        n_blocks *= 2
    out = Bloom(keys, n_blocks)
    per = min(n_blocks, PART_BLOCKS)
    every = keys.sparkSession.range(n_blocks).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("m"))
    words = keys.select(out._block(F.col("h")).alias("b"), _mask(F.col("h")).alias("m")).unionByName(every).groupBy("b").agg(F.bit_or("m").alias("m"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("b", "m"))), lambda x: x["m"])  # PART_BLOCKS rows a part
    out.parts = materialise(words.groupBy(F.floor(F.col("b") / per).cast("int").alias("__part")).agg(blocks.alias("__blocks")), "bloom")
    return out
