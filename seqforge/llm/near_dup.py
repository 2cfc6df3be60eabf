"""MinHash near-duplicates by an LSH forest.

A document's set is that of its shingles of ``size`` words (five; the report takes two). Equal sets are one class, whose
smallest id is its node. A signature is 256 MinHash values of 8 bits (lanes), in 32 longs; tree t of the forest orders the
nodes by the eight lanes from lane 6 * t on. The orders are range-partitioned sorts, so no group of copies meets in one
task. In each, a region is a run of nodes that share the first six lanes; its candidates are neighbours, which have the
longest common prefix, each node with the smallest of its region, and in a region of more than ``crowd`` nodes also with
the smallest of those that share the seventh and eighth lane: a deeper prefix where many nodes meet.

Candidates are confirmed on the full sets, in rounds: each node's most promising candidate first, then one in another
component. Then come the nodes of regions that still hold different components. They get sketches of ``SKETCH`` bits (one
bit of as many further MinHash values). Each chain of such regions is compared whole, all pairs of different components, without a cap:
a chain is dealt to tiles of about ``TILE`` nodes, and each pair of tiles meets in one task. Two nodes agree if their sketches do on
``LEAST_BITS`` bits at least (four standard deviations below a similarity of 0.8: a chance of 3e-5 there, and far less above). A task gives
a forest of the agreeing pairs, so at most a row for each of its nodes. The trees of all forests together are far smaller than the chains; their
nodes come with their texts, again in tiles (of ``TEXTS`` nodes or ``TEXT_BYTES``), where all agreeing pairs are confirmed on the
full sets, as sorted hashes of their shingles, and a forest of the confirmed links is what comes out.

Two documents of similarity 0.8 share no region in any of the 42 trees with a chance of 3e-6. Pairs whose ends are connected already are not
looked at again. A chain of n nodes in different components costs n squared comparisons of sketches, spread over (n / ``TILE``) squared / 2
tasks, but never more rows than nodes in a task.

Texts are shuffled only of rows whose id a Bloom filter of the ids asked for may hold, by one plan at every size.
Components come from min-label propagation with pointer jumping over tables in the shared folder.

Defined results: a null or empty text, or one of white space alone, has the size 0 and is linked with nothing; a text
of fewer words than ``size`` is one shingle; ids are taken to be unique, and a row that repeats is the same document again
with the same result (of different texts of one id, the smallest is compared); a null id is never a component's smallest id
(a component of null ids alone has a null id); very long texts are taken whole; an empty table gives no rows; extra columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from seqforge.llm.bloom import build
from seqforge.llm.text import arrow_column, byte_values, chunks, struct_array
from seqforge.session import materialise, ship_package

LANES, DEPTH = 256, 6
TREES = LANES // DEPTH
#: Bits of a sketch, and those that two must agree on: 0.9 of them at a similarity of 0.8, less four standard deviations.
SKETCH = 2048
LEAST_BITS = int(0.9 * SKETCH - 4 * (0.09 * SKETCH) ** 0.5)
#: Nodes that are compared with each other in an order, orders at a time, and bits of a prefix.
BLOCK, ORDERS, PREFIX = 512, 16, 64
#: Nodes of a tile of sketches, and nodes and bytes of text of a tile of texts.
TILE, TEXTS, TEXT_BYTES = 8192, 2048, 8 << 20
#: Parts of the pairs that share an end.
SALTS = 64
#: Words that a worker remembers with their hashes, and rows of an order that one task reads.
CACHE_WORDS, TASK_ROWS, SKETCH_ROWS = 100_000, 200_000, 50_000
_RNG = np.random.default_rng(20170918)
_A = _RNG.integers(0, 1 << 32, LANES + SKETCH, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, LANES + SKETCH, dtype=np.uint32)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], known: WordHashes, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of ``size`` words, sorted; of fewer words, the hash of all."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    long = min(size, len(h))
    n = len(h) - long + 1
    x = h[:n] * _M1 if long > 1 else h * _M3
    for i in range(1, long):
        x = (x * _M1 if i > 1 else x) ^ (h[i : i + n] * _M2 + _M3)
    x ^= x >> np.uint64(32)
    x *= _M3
    x ^= x >> np.uint64(29)
    return np.unique(x)


def lanes(hashes: np.ndarray, first: int, count: int) -> np.ndarray:
    """MinHash values of 8 bits by ``count`` hash functions."""
    u = (hashes >> np.uint64(32)).astype(np.uint32)
    a, b = _A[first : first + count], _B[first : first + count]
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 18) // count)
    for i in range(0, len(u), step):
        least = np.minimum(least, (u[i : i + step, None] * a + b).min(axis=0))
    # the minimum's high bits are nearly constant in a long text: mix before 8 bits are kept
    return ((least.astype(np.uint64) * _M1) >> np.uint64(56)).astype(np.uint8)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The first LANES values as longs of eight, the first one highest."""
    return lanes(hashes, 0, LANES).view(">i8").astype(np.int64)


def sketches(text: Column, size: int) -> Column:
    """binary: SKETCH bits, each of another MinHash value than the forest's."""

    def sketcher():
        known = WordHashes()

        def sketch(t: bytes) -> bytes | None:
            if len(known) > CACHE_WORDS:
                known.clear()
            found = chunks(t)
            return np.packbits(lanes(shingle_hashes(found, known, size), LANES, SKETCH) & 1).tobytes() if found else None

        return lambda texts: pa.array([sketch(t) for t in byte_values(texts)], pa.binary())

    return arrow_column(sketcher, "binary", text)


def orders(signed: Column) -> Column:
    """array<bigint> of the trees' orders: eight lanes each, from lane DEPTH * t on."""
    out = []
    for t in range(TREES):
        i, shift = divmod(8 * DEPTH * t, 64)
        high, low = F.get(signed, F.lit(i)), F.get(signed, F.lit((i + 1) % (LANES // 8)))
        out.append(F.shiftleft(high, shift).bitwiseOR(F.shiftrightunsigned(low, 64 - shift)) if shift else high)
    return F.array(*out)


def signed_sets(text: Column, size: int = 5) -> Column:
    """struct<n_shingles, set (128-bit hash; null if empty), signature array<bigint>>."""

    def signer():
        known = WordHashes()

        def sign(texts: pa.Array) -> pa.Array:
            n, sets, rows = [], [], []
            for t in byte_values(texts):
                if len(known) > CACHE_WORDS:
                    known.clear()
                words = chunks(t)
                hashes = shingle_hashes(words, known, size) if words else np.zeros(0, np.uint64)
                n.append(len(hashes))
                sets.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                rows.append(signature(hashes) if len(hashes) else np.zeros(LANES // 8, np.int64))
            flat = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (LANES // 8), pa.int32()), flat)
            return struct_array(n_shingles=pa.array(n, pa.int64()), set=pa.array(sets, pa.binary()), signature=lists)

        return sign

    return arrow_column(signer, "struct<n_shingles: bigint, set: binary, signature: array<bigint>>", text)


def shingle_set(text: bytes, size: int = 5) -> set[bytes]:
    words = chunks(text)
    long = min(size, len(words))
    return {b" ".join(x) for x in zip(*(words[i:] for i in range(long)), strict=False)}


def similar(a: Column, b: Column, percent: int, size: int = 5) -> Column:
    """Whether 100 * intersection >= percent * union on the full sets of two texts."""

    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(byte_values(left), byte_values(right), strict=True):
            x, y = shingle_set(s, size), shingle_set(t, size)
            both = len(x & y)
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return arrow_column(lambda: compare, "boolean", a, b)


def scan_order(percent: int, crowd: int):
    """For mapInArrow over a sorted part of the orders: candidate pairs (kind 0), the part's first and last rows with the
    smallest node of their region (kinds 1 and 2), and the nodes that share a region (kind 3)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        tree, place, node, n = (table.column(c).to_numpy() for c in ("tree", "place", "node", "n"))
        key = place >> (64 - 8 * DEPTH)
        edge = np.r_[True, (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])]
        pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(1, len(node))[~edge[1:]] - 1, np.arange(1, len(node))[~edge[1:]])]
        first = np.flatnonzero(edge)
        sizes = np.diff(np.r_[first, len(node)])

        def with_smallest(begins: np.ndarray, rows: np.ndarray) -> None:
            run = np.cumsum(begins) - 1
            starts = np.flatnonzero(begins)
            low = np.minimum.reduceat(node, starts)
            holder = np.full(len(starts), len(node))
            np.minimum.at(holder, run, np.where(node == low[run], np.arange(len(node)), len(node)))
            pairs.append((holder[run][rows], np.flatnonzero(rows)))

        crowded = np.repeat(sizes > crowd, sizes)
        with_smallest(edge, np.repeat(sizes > 1, sizes))
        for deeper in range(DEPTH + 1, 9) if crowded.any() else ():
            further = place >> (64 - 8 * deeper)
            with_smallest(edge | np.r_[True, further[1:] != further[:-1]], crowded)
        a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fits = (100 * small >= percent * large) & (node[a] != node[b])
        a, b = a[fits], b[fits]
        lows = np.minimum.reduceat(node, first)
        at = np.array([0, len(node) - 1])
        shared = np.unique(np.r_[node[np.repeat(sizes > 1, sizes)], node[at]])
        none = np.zeros(len(shared), np.int64)
        yield pa.record_batch(
            [
                pa.array(np.r_[np.zeros(len(a), np.int32), np.int32([1, 2]), none + 3], pa.int32()),
                pa.array(np.r_[np.minimum(node[a], node[b]), node[at], shared], pa.int64()),
                pa.array(np.r_[np.maximum(node[a], node[b]), lows[[0, -1]], none], pa.int64()),
                pa.array(np.r_[np.zeros(len(a), np.int32), tree[at], none], pa.int32()),
                pa.array(np.r_[np.zeros(len(a), np.int64), key[at], none], pa.int64()),
                pa.array(np.full(len(a) + 2 + len(none), TaskContext.get().partitionId(), np.int32)),
            ],
            names=["kind", "a", "b", "tree", "key", "part"],
        )

    return scan


def candidates(forest: DataFrame, rows: int, percent: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a < b) with the number of times that an order proposed them, and the nodes (node) that share
    a region with another one (and a few that end a part)."""
    spark = forest.sparkSession
    ship_package(spark)
    order = ["tree", "place", "node"]
    parts = max(1, -(-rows // TASK_ROWS))
    found = forest.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(scan_order(percent, crowd), "kind int, a long, b long, tree int, key long, part int")
    found = materialise(found, "proposed")
    # regions that go on in the next part: the neighbours on both sides, and the ends with the smallest node of the region
    ends = found.where("kind in (1, 2)")
    first = ends.where("kind = 1").select("tree", "key", (F.col("part") - 1).alias("part"), F.col("a").alias("x"))
    beside = ends.where("kind = 2").join(first, ["tree", "key", "part"]).select(F.col("a").alias("y"), "x")
    lowest = ends.groupBy("tree", "key").agg(F.min("b").alias("x"), F.count_distinct("part").alias("parts")).where("parts > 1").select("tree", "key", "x")
    low = ends.join(lowest, ["tree", "key"]).select(F.explode(F.array("a", "b")).alias("y"), "x")
    stitched = beside.unionByName(low).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = found.where("kind = 0").select("a", "b").unionByName(stitched)
    shared = found.where("kind = 3").select(F.col("a").alias("node")).distinct()
    return pairs.groupBy("a", "b").agg(F.count("*").alias("c")), materialise(shared, "shared")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable), for the nodes of the edges (a, b).

    A round hangs each node under its smallest neighbour, shortens the chains that this makes, and goes on with the edges
    between what is left, which are at most half as many nodes; in the end all chains are followed to their roots."""
    left = materialise(edges.select("a", "b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        under = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
        under = jump(jump(under))
        labels = under if labels is None else labels.join(under.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = materialise(labels, "labels")
        for end in "ab":
            left = left.join(under.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end)
        left = materialise(left.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges")
    while labels is not None:
        new = materialise(jump(labels, "old"), "labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            break
    return labels


def jump(labels: DataFrame, *keep: str) -> DataFrame:
    """Each node under its label's label."""
    to = labels.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return labels.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"), *[F.col("comp").alias(k) for k in keep])


def relabel(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """``labels`` after the components of further edges between components."""
    if labels is None:
        return more
    step = more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = more.join(labels.select("node"), "node", "left_anti")
    return materialise(old.unionByName(fresh.select("node", "comp")), "components")


def with_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) of which the ends are in different components, with these as ca and cb."""
    out = pairs
    for end in "ab":
        out = out.join(labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return out.where("ca <> cb")


def region(place: Column) -> Column:
    return F.shiftright(place, 64 - 8 * DEPTH)


COMPARED = "a long, b long, border long, comp long, n long, sketch binary"


def compare_near(percent: int, ends: bool = False):
    """For mapInArrow over rows sorted by (cluster, turn, prefix, node): pairs of different components that stand close and whose
    sketches agree. A run of up to BLOCK rows is compared whole, a longer one BLOCK / 2 rows to either side. ``ends``: also the rows (a, without b)
    that stand so close to an end of the part that the next one may hold others to compare, with the number of this border."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        cluster, turn, node, comp, n = (table.column(c).to_numpy() for c in ("cluster", "turn", "node", "comp", "n"))
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        edges = np.flatnonzero(np.r_[True, (cluster[1:] != cluster[:-1]) | (turn[1:] != turn[:-1]), True])
        found: list[np.ndarray] = []
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            reach = BLOCK if end - begin <= BLOCK else BLOCK // 2
            for i in range(begin, end - 1):
                j = slice(i + 1, min(end, i + 1 + reach))
                fits = np.flatnonzero((comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])))
                if len(fits):
                    other = fits + i + 1
                    other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64) <= SKETCH - LEAST_BITS]
                    found.append(np.stack([np.minimum(node[other], node[i]), np.maximum(node[other], node[i])]))
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        at, border = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if ends:
            part, last = TaskContext.get().partitionId(), len(node)
            head, tail = np.arange(min(edges[1], BLOCK // 2)), np.arange(max(edges[-2], last - BLOCK // 2), last)
            at, border = np.r_[head, tail], np.repeat([part - 1, part], [len(head), len(tail)])
        beside = table.take(pa.array(at))
        none = pa.nulls(pairs.shape[1], pa.int64())
        columns = [
            pa.array(np.r_[pairs[0], node[at]], pa.int64()),
            pa.concat_arrays([pa.array(pairs[1], pa.int64()), pa.nulls(len(at), pa.int64())]),
            pa.concat_arrays([none, pa.array(border, pa.int64())]),
            pa.concat_arrays([none, pa.array(comp[at], pa.int64())]),
            pa.concat_arrays([none, pa.array(n[at], pa.int64())]),
            pa.array([None] * pairs.shape[1] + beside.column("sketch").to_pylist(), pa.binary()),
        ]
        yield pa.record_batch(columns, names=[c.split()[0] for c in COMPARED.split(", ")])

    return scan


def prefixes(sketch: Column, sweep: int) -> Column:
    """array<struct<turn, prefix>>: ORDERS prefixes of PREFIX bits, runs of bytes of the sketch that begin elsewhere in each sweep."""
    size, out = SKETCH // 8, []
    for t in range(ORDERS):
        at = (t * (size // ORDERS) + 3 * sweep) % size
        out.append(F.struct(F.lit(t).alias("turn"), F.substring(F.concat(sketch, sketch), at + 1, PREFIX // 8).alias("prefix")))
    return F.array(*out)


def close_pairs(large: DataFrame, small: DataFrame | None, parts: int, percent: int) -> DataFrame:
    """Pairs (a, b) that :func:`compare_near` finds in the orders of ``large``, cut into ``parts`` ranges, and in whole chains."""
    order = ["cluster", "turn", "prefix", "node"]  # copies with equal prefixes go by their nodes, so a range can end among them
    scanned = large.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(compare_near(percent, ends=parts > 1), COMPARED)
    scanned = materialise(scanned, "scanned")
    # the rows on both sides of a border are a chain of at most BLOCK rows
    whole = scanned.where("b is null").select(F.col("border").alias("cluster"), F.lit(-1).alias("turn"), F.col("a").alias("node"), "comp", "n", "sketch")
    if small is not None:
        whole = whole.unionByName(small)
    met = whole.repartition("cluster").sortWithinPartitions("cluster", "turn").mapInArrow(compare_near(percent), COMPARED)
    return scanned.where("b is not null").unionByName(met).select("a", "b")


def tiled(rows: DataFrame, most: int, most_bytes: int = 0) -> DataFrame:
    """``rows`` (cluster, node, ...; t, if bytes count) once for each pair of their cluster's tiles that they are part of: lo and hi are the
    pair, tile is the row's own. A cluster of one tile is there once."""
    parts = F.ceil(F.count("*") / most)
    if most_bytes:
        parts = F.greatest(parts, F.ceil(F.sum(F.octet_length("t")) / most_bytes))
    # a row for each cluster; most are of one tile, and the few others are joined by a written table's size
    several = materialise(rows.groupBy("cluster").agg(parts.cast("int").alias("parts")).where("parts > 1"), "tiles")
    rows = rows.join(several, "cluster", "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other")
    return rows.select("*", other).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("other", "parts")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (cluster, lo, hi), one after another, of batches that are sorted by these."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("cluster", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[:, begin].tolist())
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def forest_of(table: pa.Table, percent: int, size: int, exact: bool) -> Iterator[tuple[int, int]]:
    """Of one pair of tiles the pairs of nodes that join different components, each joined as soon as it is found: pairs whose sketches
    agree or, if ``exact``, those among them that are similar on the full sets of their texts."""
    node, own, n, tile = (table.column(c).to_numpy() for c in ("node", "comp", "n", "tile"))
    if len(node) < 2:
        return
    own, cross = own.copy(), bool((tile != tile[0]).any())
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
    ids = begins = mark = None
    if exact:
        known, hashes = WordHashes(), []
        for t in byte_values(table.column("t").combine_chunks()):
            if len(known) > CACHE_WORDS:
                known.clear()
            hashes.append(shingle_hashes(chunks(t), known, size))
        begins = np.r_[0, np.cumsum([len(h) for h in hashes])]
        values, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        mark = np.zeros(len(values), np.int64)
    for i in range(len(node) - 1):
        j = slice(i + 1, len(node))
        fits = (own[j] != own[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
        if cross:  # pairs within a tile meet where the tile meets itself
            fits &= tile[j] != tile[i]
        other = np.flatnonzero(fits) + i + 1
        if not len(other):
            continue
        other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64) <= SKETCH - LEAST_BITS]
        if exact and len(other):
            mark[ids[begins[i] : begins[i + 1]]] = 1
            both = np.array([mark[ids[begins[k] : begins[k + 1]]].sum() for k in other])
            mark[ids[begins[i] : begins[i + 1]]] = 0
            sizes = begins[other + 1] - begins[other]
            other = other[100 * both >= percent * (sizes + begins[i + 1] - begins[i] - both)]
        for k in other.tolist():
            if own[k] != own[i]:
                yield int(min(node[i], node[k])), int(max(node[i], node[k]))
                own[own == own[k]] = own[i]


def forests(rows: DataFrame, percent: int, size: int, exact: bool) -> DataFrame:
    """The pairs (a, b) of :func:`forest_of` for each pair of tiles of ``rows``: no more in a task than it has nodes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            found = list(forest_of(table, percent, size, exact))
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    key = ["cluster", "lo", "hi"]
    columns = [*key, "tile", "node", "comp", "n", "sketch", *(["t"] if exact else [])]
    tiles = tiled(rows, TEXTS, TEXT_BYTES) if exact else tiled(rows, TILE)
    return tiles.select(*columns).repartition(*key).sortWithinPartitions(*key).mapInArrow(scan, "a long, b long")


def still_open(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """node, n, comp and cluster of the nodes in regions that hold different components; a cluster is a chain of such regions."""
    rows = forest.select("tree", region(F.col("place")).alias("key"), "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    regions = rows.groupBy("tree", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("node").alias("low")).where("x <> y").select("tree", "key", "low")
    rows = materialise(rows.join(regions, ["tree", "key"]).groupBy("node", "low").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "open")
    clusters = components(rows.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")))
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    if clusters is None:
        return nodes.select("node", "n", "comp", F.col("node").alias("cluster")).limit(0)
    return nodes.join(clusters.withColumnRenamed("comp", "cluster"), "node")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 80, crowd: int = 64, size: int = 5) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id and kept."""
    signed = docs.select(F.col(id_col).cast("long").alias("doc_id"), signed_sets(F.col(text_col), size).alias("s"))
    signed = materialise(signed.select("doc_id", "s.n_shingles", "s.set", "s.signature"), "signed")
    classes = signed.where("set is not null and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = materialise(classes, "classes")
    forest = classes.select("node", "n", F.posexplode(orders(F.col("signature"))).alias("tree", "place"))
    pairs, shared = candidates(forest, classes.count() * TREES, percent, crowd)
    pairs = materialise(pairs, "candidates")
    labels = link(docs, forest, pairs, shared, text_col, id_col, percent, size)
    own = classes.select("set", "node")
    if labels is not None:
        own = own.join(labels, "node", "left").select("set", F.coalesce("comp", "node").alias("component"))
    else:
        own = own.withColumnRenamed("node", "component")
    out = signed.select("doc_id", "n_shingles", "set").join(own.select(F.col("set").alias("set2"), "component"), F.col("set") == F.col("set2"), "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def link(docs: DataFrame, forest: DataFrame, pairs: DataFrame, shared: DataFrame, text_col: str, id_col: str, percent: int, size: int = 5) -> DataFrame | None:
    """node and comp of all nodes that a confirmed link joins; None without links."""
    if pairs.isEmpty():
        return None
    # the texts of all nodes that any round may look at, taken once; of texts of one id the smallest
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
    texts = build(shared).flag(texts, F.col("node")).where("__maybe").drop("__maybe").join(shared, "node", "left_semi")
    texts = materialise(texts.groupBy("node").agg(F.min("t").alias("t")), "texts")

    def confirmed(asked: DataFrame, name: str) -> DataFrame:
        # one end may be that of most pairs, as the smallest of a large family is: its text comes to each of its salts once, and meets
        # the pairs there
        pairs = asked.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
        hot = pairs.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(hot, ["a", "salt"])
        return materialise(both.select("a", "b", similar(F.col("ta"), F.col("tb"), percent, size).alias("near")), name)

    def best(of: DataFrame, order: Column) -> DataFrame:
        ends = of.select("a", "b", "c", F.explode(F.array("a", "b")).alias("node"))
        chosen = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), order).alias("p"))
        return chosen.select("p.a", "p.b").distinct()

    # first the smallest partner that shares about as many regions as a similarity of 0.8 makes likely, else that with most
    promising = F.least("c", F.lit(9))
    asked = confirmed(best(pairs, F.struct(promising, -F.col("a"), F.col("c"))), "first")
    links = asked.where("near")
    if links.isEmpty():
        labels = forest.select("node", F.col("node").alias("comp")).limit(0)
    else:
        labels = components(links)
    left = materialise(with_components(pairs, labels).join(asked.select("a", "b"), ["a", "b"], "left_anti"), "left")
    if not left.isEmpty():
        labels = joined(labels, confirmed(best(left, F.struct("c", -F.col("a"))), "second"))
    opened = still_open(forest.join(shared, "node", "left_semi"), labels)
    sketched = texts.join(opened.select("node", "n", "comp", "cluster"), "node").select("node", "n", "comp", "cluster", sketches(F.col("t"), size).alias("sketch")).where("sketch is not null")
    sketched = materialise(sketched, "sketched")
    agreeing = materialise(forests(sketched, percent, size, False), "agreeing")
    if agreeing.isEmpty():
        return labels
    # components are joined in an order that differs from tile to tile, so all nodes of the components that agree belong together
    ends = with_components(agreeing, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    groups = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("cluster"))
    close = sketched.drop("cluster").join(groups, "comp").join(texts, "node")
    links = materialise(forests(close, percent, size, True), "third")
    return joined(labels, links.withColumn("near", F.lit(True)))


def joined(labels: DataFrame, asked: DataFrame) -> DataFrame:
    links = with_components(asked.where("near").select("a", "b"), labels).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return labels if links.isEmpty() else relabel(labels, components(links))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; of rows that repeat an id, the one with the smallest text
    stays. Rows with a null id all stay, as nothing can be told to keep in their place."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = materialise(near_duplicates(docs, **options).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")), "kept")
    judged = found.where("not kept or rows > 1").select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept"))
    own = F.col(id_col).cast("long")
    # only rows that the filter of the judged ids may hold are shuffled
    flagged = build(judged.select("__id")).flag(docs, own)
    some = flagged.where("__maybe").join(judged, own == F.col("__id"), "left").where("__kept is null or __kept")
    place = Window.partitionBy(F.col("__id")).orderBy(text_col, *[c for c in docs.columns if c != text_col and not isinstance(docs.schema[c].dataType, MapType)])
    once = some.where("__kept").withColumn("__place", F.row_number().over(place)).where("__place = 1")
    return flagged.where("not __maybe").select(*docs.columns).unionByName(some.where("__kept is null").select(*docs.columns)).unionByName(once.select(*docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """The classes of the documents by shingles of two words."""
    return near_duplicates(docs, size=2)


#: DuckDB: the exact join of all pairs that share a shingle, and reachability.
ORACLE_SQL = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
sh as materialized (select distinct doc_id, s from (select doc_id, unnest(case when len(ws) = 1 then ws else list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) end) s from w where len(ws) > 0)),
sz as materialized (select doc_id, count(*) n from sh group by doc_id),
link as materialized (select a, b from (select x.doc_id a, y.doc_id b, count(*) c from sh x join sh y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2)
  join sz p on p.doc_id = a join sz q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) as (select doc_id, doc_id from w union select reach.a, link.b from reach join link on reach.b = link.a),
low as (select a doc_id, min(b) component_id from reach group by a)
select w.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, component_id, w.doc_id = component_id kept from w left join sz on w.doc_id = sz.doc_id join low on w.doc_id = low.doc_id
"""
