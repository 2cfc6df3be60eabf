"""Approximate nearest neighbours by a permutation index.

Each vector is represented by its ``depth`` nearest of ``n_pivots`` pivots, in order. The index is a table of blocks of
vectors; a block holds the inverted files of the pivots: for a pivot, the vectors that have it among their nearest,
with its place there. A query sums up, over the inverted files of its own nearest pivots, how far each vector's
permutation is from its own (Spearman's footrule, with a pivot that is missing on one side placed at ``depth``). How far
that lies below the block's mean, times the vector's norm, ranks the vectors, as permutations know directions only. The
best ``share`` of a block, and ``least`` vectors at least, are then ranked by the exact measure, the inner product in
double precision on the original vectors; all that tie are kept until ids decide. Rows are dealt to blocks in the order of
their norms, and a block whose largest norm cannot give a product among the nearest known is skipped. Equal vectors of a block
are indexed once with the smallest of their ids, more than which can't be among the nearest.

Pivots are chosen from a bounded sample (``8 * n_pivots`` rows by a hash of the id) so that they lie apart; every row is
indexed. The queries are a stated set, packed in blocks of ``QUERY_BLOCK``; each of their blocks meets each block of the
index in a task of its own or of a few pairs, so neither side is collected or broadcast as a whole, and a task holds two
blocks and the nearest of one block of queries. Recall is measured in the tests against brute force.

Defined results: rows whose id or vector is null, whose vector is zero, or holds a null, NaN or infinite component, or is
not of the most common length, take no part; an id that repeats is one candidate with its best score, and one query;
equal scores go by the smaller id; with fewer candidates than asked for, all are returned; more than ``keep - 1`` nearest
are an error; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqforge.session import materialise, ship_package

BLOCK, QUERY_BLOCK = 4096, 512


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0][0] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; ties to the smaller pivot."""
    near = np.round(unit(x) @ pivots.T, 12)
    return np.argsort(-near, axis=1, kind="stable")[:, :depth].astype(np.int32)


def fit_pivots(rows: DataFrame, n_pivots: int, apart: float = 0.8) -> np.ndarray:
    """Up to ``n_pivots`` sampled vectors, none with a cosine above ``apart`` to another: pivots of one dense cluster would
    fill the permutations of all that is near it, and tell nothing."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * n_pivots).select("vector").collect()
    return spread(unit(np.array([r[0] for r in sample])), n_pivots, apart) if sample else np.zeros((0, 1))


def spread(x: np.ndarray, n: int, apart: float) -> np.ndarray:
    free, chosen = np.ones(len(x), bool), []
    while len(chosen) < n and free.any():
        i = int(free.argmax())
        chosen.append(i)
        free &= x @ x[i] <= apart
        free[i] = False
    return x[chosen]


@dataclass
class Index:
    """Blocks (a table in the shared folder), the pivots, and what was chosen when it was built."""

    blocks: DataFrame
    pivots: np.ndarray
    depth: int
    keep: int


class Block:
    """The inverted files of one block: ``ids`` has the smallest ids of each distinct vector."""

    def __init__(self, row: dict, dim: int, depth: int):
        counts = np.frombuffer(row["counts"], np.int32)
        self.ids = np.split(np.frombuffer(row["ids"], np.int64), np.cumsum(counts)[:-1])
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.row, self.short = np.frombuffer(row["postings"], np.int16), np.frombuffer(row["places"], np.int16)
        self.begin = np.frombuffer(row["begins"], np.int32)
        self.ranks = np.arange(depth, dtype=np.int16) - np.int16(depth)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Half of each vector's footrule from a query's permutation, up to a constant. A pivot at places a and r counts
        abs(a - r) instead of the depth's (d - a) + (d - r) of two that miss it: a difference of twice max(a, r) - d."""
        parts = [slice(a, b) for a, b in zip(self.begin[order].tolist(), self.begin[order + 1].tolist(), strict=True)]
        row = np.concatenate([self.row[s] for s in parts])
        short = np.concatenate([self.short[s] for s in parts])
        rank = np.repeat(self.ranks, [s.stop - s.start for s in parts])
        return np.bincount(row, np.maximum(short, rank), minlength=len(self.vectors))

    def nearest(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, share: float, least: int) -> list[tuple[float, int]]:
        """(score, negated, and id) of the nearest found."""
        n = len(self.vectors)
        wanted = min(n, max(least, int(np.ceil(share * n))))
        found = np.arange(n)
        if wanted < n:
            far = self.footrule(order)
            found = np.argpartition((far - far.mean()) * self.norms, wanted - 1)[:wanted]
        rough = self.vectors[found] @ query
        if len(found) > k + 1:  # all that may be among the nearest, ties included; rough products differ by rounding only
            bar = np.partition(rough, -(k + 1))[-(k + 1)]
            found = found[rough >= bar - 1e-9 * (abs(bar) + self.norms[found].max() * np.linalg.norm(query))]
        scores = (self.vectors[found] * query).sum(axis=1)
        out = [(-s, i) for s, f in zip(scores.tolist(), found.tolist(), strict=True) for i in self.ids[f][: k + 1].tolist() if i != query_id]
        return sorted(out)[:k]


def norms_of(x: np.ndarray) -> np.ndarray:
    size = np.abs(x).max(axis=1)
    return np.minimum(size * np.linalg.norm(x / size[:, None], axis=1), 1e300)


def tables(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of ``size`` (the last has fewer), whatever the batches are."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        while n >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held, n = table.slice(size).to_batches(), n - size
    if n:
        yield pa.Table.from_batches(held)


BLOCK_KIND = "ids binary, counts binary, vectors binary, norms binary, postings binary, places binary, begins binary"


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = 512, depth: int = 128, keep: int = 101) -> Index:
    """The index of all rows that take part. ``keep``: ids kept of equal vectors of a block, one more than any search asks for."""
    spark = df.sparkSession
    ship_package(spark)
    rows = materialise(valid(df, id_col, vector_col), "vectors")
    pivots = fit_pivots(rows, n_pivots)
    shared = spark.sparkContext.broadcast(pivots)  # n_pivots rows at most
    deep = min(depth, len(pivots))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tables(batches, BLOCK):
            part = part.combine_chunks()
            ids, x = part.column("vec_id").to_numpy(), matrix(part.column("vector").chunk(0)) + 0.0  # no negative zeros
            distinct, which = np.unique(x, axis=0, return_inverse=True)
            by = np.lexsort((ids, which.ravel()))
            groups = np.split(ids[by], np.cumsum(np.bincount(which.ravel()))[:-1])
            groups = [np.unique(g)[:keep] for g in groups]
            order = permutations(distinct, shared.value, deep).ravel()
            place = np.argsort(order, kind="stable")
            begins = np.searchsorted(order[place], np.arange(len(shared.value) + 1)).astype(np.int32)
            cells = [
                b"".join(g.tobytes() for g in groups), np.array([len(g) for g in groups], np.int32).tobytes(), distinct.tobytes(), norms_of(distinct).tobytes(),
                (place // deep).astype(np.int16).tobytes(), (place % deep - deep).astype(np.int16).tobytes(), begins.tobytes(),
            ]
            yield pa.record_batch([pa.array([c], pa.binary()) for c in cells], names=[c.split()[0] for c in BLOCK_KIND.split(", ")])

    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    order = [F.col("norm").desc(), F.col("vec_id")]
    n = max(1, -(-rows.count() // (4 * BLOCK)))
    sorted_rows = rows.withColumn("norm", size).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return Index(materialise(sorted_rows.mapInArrow(blocks, BLOCK_KIND), "permutation-index"), pivots, deep, keep)


def search(index: Index, queries: DataFrame, k: int = 20, share: float = 0.08, least: int = 300) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found. ``queries``: vec_id, vector, as :func:`valid`."""
    if k >= index.keep:
        raise ValueError(f"the index holds {index.keep} ids of equal vectors; build it with keep > {k}")
    spark, deep = index.blocks.sparkSession, index.depth
    kind = "query_id long, vec_id long, score double"
    if not len(index.pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index.pivots)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(tables(batches, QUERY_BLOCK)):
            part = part.combine_chunks()
            x = matrix(part.column("vector").chunk(0))
            cells = [part.column("vec_id").to_numpy().tobytes(), x.tobytes(), permutations(x, shared.value, deep).tobytes()]
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() << 32 | i], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["pack", "q_ids", "q_vectors", "q_orders"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, vectors, orders, best = None, None, None, None, []

        def found() -> pa.RecordBatch:
            cells = [(q, v, -s) for q, b in zip(own.tolist(), best, strict=True) for s, v in b]
            return pa.record_batch([pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for row in (r for batch in batches for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
            if row["pack"] != now:
                if now is not None:
                    yield found()
                now, own = row["pack"], np.frombuffer(row["q_ids"], np.int64)
                vectors = np.frombuffer(row["q_vectors"], np.float64).reshape(len(own), -1)
                orders, best = np.frombuffer(row["q_orders"], np.int32).reshape(len(own), -1), [[] for _ in own]
                sizes = norms_of(vectors)
            block = Block(row, vectors.shape[1], deep)
            top = block.norms.max()
            for j, query_id in enumerate(own.tolist()):
                if len(best[j]) == k and sizes[j] * top * (1 + 1e-9) < -best[j][-1][0]:
                    continue  # no vector of the block reaches the nearest known
                ranked, seen = [], set()
                for s, v in sorted(best[j] + block.nearest(query_id, vectors[j], orders[j], k, share, least)):
                    if v not in seen:
                        seen.add(v)
                        ranked.append((s, v))
                best[j] = ranked[:k]
        if now is not None:
            yield found()

    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n = max(1, -(-asked.count() // QUERY_BLOCK))
    packs = materialise(asked.repartition(n, "vec_id").mapInArrow(pack, "pack long, q_ids binary, q_vectors binary, q_orders binary"), "queries")
    # a pair of blocks is some MB: a batch for each. Every block of the stated queries meets every block of the index.
    rows_key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_key)
    spark.conf.set(rows_key, 1)
    try:
        near = materialise(packs.repartition(n).crossJoin(index.blocks).mapInArrow(look, kind), "near")
    finally:
        spark.conf.set(rows_key, before)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The nearest of each vector whose id is divisible by ``every``, among all others."""
    return search(build_index(df), valid(df, "vec_id", "embedding").where(F.col("vec_id") % every == 0), k)
