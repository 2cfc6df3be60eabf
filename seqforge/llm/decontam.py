"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an item of fewer words, but not none, is
one window). Windows of one length form a matcher: a table of shifts, looked up by a hash of a block of words, skips
positions at which no window can end (blocks that share a place in the table keep the smallest shift, so nothing is
missed); where the shift is zero, the windows whose last block has the same hash are selected, among these that with the
hash of all its words, and this is compared with the text directly, byte by byte. Equal windows are one, with a list of the items that
have it, which a document takes once however often the window occurs. A matcher is a few numpy arrays beside the
benchmark's words: some 35 bytes a window.

A benchmark is taken in parts of about ``part_bytes`` of text; a worker holds the matchers of one part. Further parts are
jobs of their own over the table that the one before has written. Long items are cut into pieces that overlap by a window
less a word before anything comes to the driver, so that no part is larger than stated.

Defined results: null and empty texts have no words and no hits; items that are null, empty or without an id take no
part; items that repeat count once for an id; documents that repeat get a row each; very long texts are searched whole;
an empty table gives no rows, and an empty benchmark no hits; extra columns pass through, and a column of the added name
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.llm.text import arrow_column, byte_values, struct_array, words
from seqforge.session import materialise

#: UTF-8 bytes of benchmark text of one part (its matchers are some 8 times as large), and words of a piece of a long item.
PART_BYTES, PIECE_WORDS = 4 << 20, 4096
#: Words that a worker remembers with their hashes.
CACHE_WORDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
KIND = "struct<n_words: bigint, n_hit: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: list[bytes], known: WordHashes) -> np.ndarray:
    if len(known) > CACHE_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, text), np.uint64, len(text))


def block_hashes(hashes: np.ndarray, block: int) -> np.ndarray:
    """A hash of each run of ``block`` words, at the place of its last word less ``block - 1``."""
    n = len(hashes) - block + 1
    out = hashes[:n].copy()
    for i in range(1, block):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i : i + n]
    return (out ^ (out >> np.uint64(32))) * _MIX


def hashes_at(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each of ``starts`` on."""
    out = hashes[starts].copy()
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * _MIX + hashes[starts + i]
    return out


class WuManber:
    """Finds all occurrences of the windows of one length of items, given as (number, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int):
        self.size, self.block = size, min(3, size)
        self.most = size - self.block + 1
        known = WordHashes()
        text: list[bytes] = []
        starts, owners = [], []
        for number, item in items:
            n = len(item) - size + 1
            starts.append(np.arange(len(text), len(text) + n, dtype=np.int32))
            owners.append(np.full(n, number, np.int32))
            text += item
        starts, owners = np.concatenate(starts), np.concatenate(owners)
        #: All words one after another, and where each begins.
        self.text = b" ".join(text)
        self.at = np.cumsum([0, *(len(w) + 1 for w in text)]).astype(np.int64)
        of_words = word_hashes(text, known)
        hashes, full = block_hashes(of_words, self.block), hashes_at(of_words, starts, size)
        bits = max(10, int(np.ceil(np.log2(8 * len(hashes) + 1))))
        self.right = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.most, np.uint8 if self.most < 256 else np.int32)
        for k in range(self.most):  # a block whose last word is k words before a window's end
            np.minimum.at(self.shift, hashes[starts + self.most - 1 - k] >> self.right, k)
        last = hashes[starts + self.most - 1]
        order = np.lexsort((starts, full, last))
        last, full, starts, owners = last[order], full[order], starts[order], owners[order]
        one = np.cumsum(self._differs(last, full, starts)) - 1  # the number of each distinct window
        first = np.unique(one, return_index=True)[1]
        self.last, self.full, self.starts = last[first], full[first], starts[first]
        pairs = np.unique(one.astype(np.int64) << 32 | owners)
        self.owners = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.begin = np.searchsorted(pairs >> 32, np.arange(len(first) + 1)).astype(np.int32)

    def _window(self, start: int) -> bytes:
        return self.text[self.at[start] : self.at[start + self.size] - 1]

    def _differs(self, last: np.ndarray, full: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether a window is another one than that before it: hashes tell, and the bytes where these are equal."""
        out = np.r_[True, (last[1:] != last[:-1]) | (full[1:] != full[:-1])]
        for i in np.flatnonzero(~out).tolist():
            out[i] = self._window(starts[i]) != self._window(starts[i - 1])
        return out

    def find(self, text: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """The start of each occurrence, and the number of the window."""
        if len(text) < self.size:
            return
        blocks = block_hashes(hashes, self.block)[self.most - 1 :]  # of each possible end of a window
        shifts = self.shift[blocks >> self.right]
        if shifts.all():
            return
        steps, i, ends = shifts.tolist(), 0, []
        while i < len(steps):
            if step := steps[i]:
                i += step
            else:
                ends.append(i)
                i += 1
        ends = np.array(ends, np.int64)
        low, high = (np.searchsorted(self.last, blocks[ends], side) for side in ("left", "right"))
        chosen = low < high
        ends, low, high = ends[chosen], low[chosen], high[chosen]
        for start, whole, a, b in zip(ends.tolist(), hashes_at(hashes, ends, self.size), low.tolist(), high.tolist(), strict=True):
            k = a + int(np.searchsorted(self.full[a:b], whole))
            here = b" ".join(text[start : start + self.size]) if k < b and self.full[k] == whole else None
            while k < b and self.full[k] == whole:
                if self._window(self.starts[k]) == here:
                    yield start, k
                k += 1

    def owners_of(self, windows: set[int]) -> np.ndarray:
        """The numbers of the items that have any of ``windows``."""
        return np.unique(np.concatenate([self.owners[self.begin[k] : self.begin[k + 1]] for k in windows]))


class Matchers:
    """The matchers of a part of a benchmark: pieces of items as (id, words)."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.items = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.items)}
        by_size: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item, of in pieces:
            if of:
                by_size.setdefault(min(window, len(of)), []).append((number[item], of))
        self.matchers = [WuManber(of, size) for size, of in sorted(by_size.items())]

    def scan(self, text: bytes, known: WordHashes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the merged spans of words that are hit, and the items that occur."""
        text_words = words(text)
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.matchers and text_words:
            hashes = word_hashes(text_words, known)
            for matcher in self.matchers:
                windows: set[int] = set()
                for start, window in matcher.find(text_words, hashes):
                    hits.append((start, start + matcher.size))
                    windows.add(window)
                if windows:
                    items.update(matcher.owners_of(windows).tolist())
        return len(text_words), merged(hits), {self.items[i] for i in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pieces_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item (string) and piece (array of words): the items' words in runs of PIECE_WORDS, and ``window - 1`` words more."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item_id is not null and text is not null")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = items.select("item", F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("ws")).where(F.size("ws") > 0)
    cuts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)), F.lit(PIECE_WORDS))
    return items.select("item", "ws", F.explode(cuts).alias("i")).select("item", F.slice("ws", F.col("i") + 1, PIECE_WORDS + window - 1).alias("piece"))


def parts(benchmark: DataFrame, window: int, part_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The pieces in lists of about ``part_bytes`` of text; each list is taken alone, so the driver never holds more."""
    pieces = materialise(pieces_of(benchmark, window), "benchmark")
    total = pieces.agg(F.sum(F.octet_length(F.array_join("piece", " ")))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    for k in range(n):
        part = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(n)) == k)
        yield [(r[0], [w.encode() for w in r[1]]) for r in part.distinct().collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``leak``: n_words, n_hit, spans (merged, of words, end exclusive) and items (distinct, sorted)."""
    out = docs.drop("leak")
    sc = docs.sparkSession.sparkContext
    for k, part in enumerate(parts(benchmark, window, part_bytes)):
        shared = sc.broadcast(Matchers(part, window))

        def finder(shared=shared):
            own, known = shared.value, WordHashes()
            return lambda texts: _leaks(own.scan(text, known) for text in byte_values(texts))

        one = arrow_column(finder, KIND, F.col(text_col))
        if k == 0:
            out = out.withColumn("leak", one)
        else:  # a job of its own, with the matchers of this part alone
            out = materialise(out, "searched")
            out = out.withColumn("leak", arrow_column(lambda: _both, KIND, F.col("leak"), one))
    return out


def _both(a: pa.Array, b: pa.Array) -> pa.Array:
    def spans(x: dict) -> list[tuple[int, int]]:
        return [(s["start"], s["end"]) for s in x["spans"]]

    return _leaks((x["n_words"], merged(spans(x) + spans(y)), {*x["items"], *y["items"]}) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True))


def _leaks(rows: Iterator[tuple[int, list[tuple[int, int]], set[str]]]) -> pa.Array:
    n, hit, spans, items = [], [], [], []
    for n_words, found, of in rows:
        n.append(n_words)
        hit.append(sum(e - s for s, e in found))
        spans.append([{"start": s, "end": e} for s, e in found])
        items.append(sorted(of))
    return struct_array(n_words=pa.array(n, pa.int64()), n_hit=pa.array(hit, pa.int64()), spans=pa.array(spans, pa.list_(_SPAN)), items=pa.array(items, pa.list_(pa.string())))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The digest of :func:`decontaminate` for each document."""
    out = decontaminate(docs.select("doc_id", "text"), benchmark, window)
    items = F.col("leak.items")
    return out.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        F.col("leak.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


#: DuckDB: the same report. ASCII letters are lower-cased by translate.
ORACLE_SQL = r"""
with lowered as (
  select doc_id, row_number() over () r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as materialized (select doc_id, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from lowered),
bw as (select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from benchmark where item_id is not null and text is not null),
pat as materialized (select distinct item, least(len(ws), 10) n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') p
  from (select item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) i from bw where len(ws) > 0)),
sizes as (select distinct n from pat),
win as (select r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') p
  from (select r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) i from w, sizes where len(ws) >= n)),
hit as materialized (select r, i, win.n n, item from win join pat on win.p = pat.p and win.n = pat.n),
cover as (select r, count(distinct pos) n_hit from (select r, unnest(generate_series(i, i + n - 1)) pos from (select distinct r, i, n from hit)) group by r),
items as (select r, count(distinct item) n_items, string_agg(item, ',' order by item collate "C") s from (select distinct r, item from hit) group by r)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join cover using (r) left join items using (r)
""".replace(' collate "C"', "")
