"""An audit of quality filters: what each removes at each step of every order in which they can be applied.

Every text is read once, for the flags of the filters that need it alone. Whether it repeats an earlier one is decided by
the smallest id of its digest; only digests that repeat are joined back, dealt over ``SALTS`` parts, so that a text that a
third of the rows share is no hot key. What remains of a row is its part and seven bits. A task packs these into NumPy bitsets of 64-bit words (one for each
filter and label, rows in the order of their parts, so that a part's bitset is a range of words with masked ends), and for
every subset of filters that can go before, AND-NOT and popcounts give what another filter removes there, how many of these are good or toxic,
and what it keeps. A part has ``2**(k-1) * k`` such rows in a task, which are summed over the tasks; the orders are read off the sums.

Defined results: a null text is empty, a null part the empty string; a null id is compared with none, neither as the smaller one nor as
the larger; rows that share an id and a text are not smaller than each other, and each counts; of labels that repeat an id the
largest counts, null or missing ones are 0; an empty table gives no rows; texts are taken whole; other columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.session import materialise, ship_package

#: The filters' letters, in the order of their bits; the labels' bits follow.
FILTERS = "ABCDE"
#: Parts over which a repeated digest is dealt, and rows that are packed at once.
SALTS, ROWS = 32, 1 << 20
_COUNTS = "part string, prefix int, filter int, removed long, good long, toxic long, kept long"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), F.rlike(text, F.lit("[#$%&*|]"))]


def bits_of(flags: list[Column], first: int = 0) -> Column:
    out = F.lit(0)
    for i, flag in enumerate(flags, first):
        out = out + F.when(flag, F.lit(1 << i)).otherwise(F.lit(0))
    return out.cast("int")


def flagged(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part and bits of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part_col), F.lit("")).alias("part"), bits_of(text_failures(text)).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialise(rows, "audit-rows")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.select(F.col("doc_id").alias("key"), F.lit(False).alias("none"), bits_of([F.col("quality") == 1, F.col("toxic") == 1], len(FILTERS)).alias("labels"))
    # rows without an id have no label; their keys spread them
    rows = rows.withColumns({"none": F.col("doc_id").isNull(), "key": F.coalesce("doc_id", F.xxhash64("digest"))})
    rows = rows.join(known, ["key", "none"], "left")
    repeated = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeated = repeated.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(repeated, ["digest", "salt"], "left")
    later = bits_of([F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))], len(FILTERS) - 1)
    return rows.select("part", (F.col("bits") + F.coalesce("labels", F.lit(0)) + later).cast("int").alias("bits"))


def packed(flags: np.ndarray) -> np.ndarray:
    """Flags as 64-bit words."""
    out = np.packbits(flags, bitorder="little")
    return np.pad(out, (0, -len(out) % 8)).view(np.uint64)


def between(low: int, high: int) -> np.ndarray:
    """The bitset of the rows from ``low`` to ``high``, in the words that hold them."""
    flags = np.zeros(-(-high // 64) * 64 - low // 64 * 64, bool)
    flags[low % 64 : low % 64 + high - low] = True
    return packed(flags)


def prefix_counts(bits: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """code of a part, prefix (a set of filters, as bits), filter, and how many rows the filter removes after the prefix, how many
    of these are good and toxic, and how many it keeps; for every filter and prefix without it."""
    order = np.argsort(codes, kind="stable")
    bits, codes = bits[order], codes[order]
    k = len(FILTERS)
    sets = [packed((bits >> i) & 1) for i in range(k + 2)]
    fails, good, toxic = sets[:k], sets[k], sets[k + 1]
    gone = [np.zeros_like(good)]  # rows that a subset of the filters removes
    for prefix in range(1, 1 << k):
        last = prefix.bit_length() - 1
        gone.append(gone[prefix ^ (1 << last)] | fails[last])
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    count = lambda x: int(np.bitwise_count(x).sum())
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
        words, own = slice(low // 64, -(-high // 64)), between(low, high)
        for prefix in range(1 << k):
            alive = own & ~gone[prefix][words]
            for i in range(k):
                if not prefix >> i & 1:
                    hit = alive & fails[i][words]
                    yield int(codes[low]), prefix, i, count(hit), count(hit & good[words]), count(hit & toxic[words]), count(alive & ~fails[i][words])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        bits, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        known = list(names)
        columns = list(zip(*prefix_counts(bits, codes), strict=True))
        arrays = [pa.array([known[i] for i in columns[0]], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:3]), *(pa.array(c, pa.int64()) for c in columns[3:])]
        return pa.RecordBatch.from_arrays(arrays, ["part", "prefix", "filter", "removed", "good", "toxic", "kept"])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").dictionary_encode()
        own = np.array([names.setdefault(p, len(names)) for p in parts.dictionary.to_pylist()], np.int64)
        held.append((batch.column("bits").to_numpy().astype(np.uint8), own[parts.indices.to_numpy()]))
        if sum(len(b) for b, _ in held) >= ROWS:
            yield counted()
            held.clear()
            names.clear()
    if held:
        yield counted()


def subset_counts(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (part, bits), removed, good, toxic and kept of each part, prefix and filter."""
    ship_package(rows.sparkSession)
    found = rows.mapInArrow(_count_batches, _COUNTS)
    return found.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic", "kept")])


def orders() -> list[tuple[str, int, int, int]]:
    """filter_order, step, prefix and filter of each step of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for step, i in enumerate(order, 1):
            out.append(("".join(FILTERS[j] for j in order), step, sum(1 << j for j in order[: step - 1]), i))
    return out


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """A row for each part, order and step."""
    counts = materialise(subset_counts(flagged(docs, labels, part_col)), "audit-counts")  # 80 rows a part
    k, every = len(FILTERS), (1 << len(FILTERS)) - 1
    #: How many orders have these filters first and then this one.
    weight = F.lit(0)
    for prefix in range(1 << k):
        size = prefix.bit_count()
        weight = F.when(F.col("prefix") == prefix, F.lit(factorial(size) * factorial(max(0, k - 1 - size)))).otherwise(weight)
    alone = F.col("prefix") == F.lit(every) - F.expr("shiftleft(1, filter)")
    of_filter = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    steps = F.broadcast(docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, prefix int, filter int"))  # 600 rows
    out = counts.join(of_filter, ["part", "filter"]).join(steps, ["prefix", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


_BITS_SQL = " + ".join(f"case when {x} then {1 << i} else 0 end" for i, x in enumerate(("n < 200", "100 * u < 50 * n", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)", "regexp_matches(t, '[#$%&*|]')", "doc_id > first")))
ORACLE_SQL = f"""with d as materialized (select doc_id, coalesce(text, '') t, coalesce(lang, '') part from documents), f as (select t, min(doc_id) first from d group by t),
w as (select d.*, first, list_filter(regexp_split_to_array(d.t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from d join f on d.t = f.t),
n as (select *, len(ws) n, len(list_distinct(ws)) u from w), k as (select doc_id, max(quality) quality, max(toxic) toxic from labels group by doc_id),
b as materialized (select part, {_BITS_SQL} bits, coalesce(quality, 0) = 1 good, coalesce(toxic, 0) = 1 toxic, count(*) c from n left join k using (doc_id) group by all),
x(i) as (select unnest(range(5))),
p as (select [v.i, w.i, x.i, y.i, z.i] o from x v, x w, x, x y, x z where len(list_distinct([v.i, w.i, x.i, y.i, z.i])) = 5),
s as materialized (select array_to_string(list_transform(o, lambda j: substr('ABCDE', j + 1, 1)), '') filter_order, cast(step as int) step, 1 << o[step] own, coalesce(list_sum(list_transform(o[1:step - 1], lambda j: 1 << j)), 0)::bigint before from p, range(1, 6) r(step)),
r as materialized (select part, filter_order, step, own, sum(case when bits & (before | own) = 0 then c else 0 end) kept, sum(case when bits & own <> 0 and bits & before = 0 then c else 0 end) removed,
  sum(case when bits & own <> 0 and bits & before <> 0 then c else 0 end) redundant, sum(case when bits = own then c else 0 end) unique_fails,
  sum(case when bits & own <> 0 and bits & before = 0 and good then c else 0 end) good_lost, sum(case when bits & own <> 0 and bits & before = 0 and toxic then c else 0 end) toxic_lost from b, s group by part, filter_order, step, own)
select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) shapley from r"""
