"""Secret scans by corpus-wide ownership frequency; DataFrame operations only.

Three base kinds of credentials are found in every text by regular expressions, and more kinds as candidates. Hashes of
all candidates' values are aggregated over the whole corpus by distinct repositories and owners. A value that ``wide`` or
more owners hold is a widely copied example; one of fewer owners that mixes character classes looks live. Base finds
always stay; a candidate of a further kind is reported where it looks live.

Positions come from splitting a text at the matches: the lengths of the pieces and matches before one sum up to its
start. They are code points, the end exclusive. Running sums inside a row go by chunks of ``CHUNK`` elements, so the work
on a text grows in proportion to its finds.

Quick tests tell, row by row, which texts can hold a find. Only these (a few in a hundred) take part in the aggregation and in
the join of the verdicts; the other rows pass through untouched. The plan is the same at every size.

Defined results: a null text counts as empty and has no finds; a null owner or repository counts as one of its own; rows
that repeat get a row each with the same finds; rows with a null id are told apart by their texts; very long texts are
scanned whole; an empty table gives no rows; extra columns pass through, and a column of the added name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.session import materialise

#: The base kinds in their order, as (kind, quick test, pattern, group, least length of the group).
#: Runs of the last two kinds are matched from their needed length on: a shorter run holds no match at all.
BASE = [
    ("assign", "(?i)passw|secret|token|api_?key", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24}", "[0-9a-f]{24,}", 0, 24),
]
#: Further kinds, reported only where their values look live.
MORE = [
    ("prefixed", "gh[pousr]_|xox[abprs]-|[sr]k_live_", r"(?:gh[pousr]_|xox[abprs]-|[sr]k_live_)[A-Za-z0-9_-]{16,}", 0, 20),
    ("bearer", "eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]
#: Owners from which on a value is a widely copied example.
WIDE = 3
#: Elements of an array that are summed up one after another, and code points of a piece of a text that is redacted.
CHUNK, PIECE = 64, 1024


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints, ``op`` (a sum or a maximum) over 0 and the elements before it. An array that grows by
    one element is copied each time, so it grows in chunks only, and over the chunks' totals."""
    zero, empty = F.lit(0), F.array().cast("array<int>")

    def scan(array: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(array, F.struct(start.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        cut = F.transform(F.sequence(zero, F.floor(F.size(v) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        return bind(cut, lambda chunks: F.flatten(F.zip_with(chunks, scan(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero), scan)))

    return bind(values, whole)


def find_all(text: Column, kind: str, quick: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<kind, start, end, value>>: leftmost matches that do not overlap, without those whose group is short."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("p"), F.transform(whole, lambda m: F.length(m)).alias("m"), value.alias("v"))

    def spans(r: Column) -> Column:
        ends = running(F.transform(r, lambda x: x["p"] + F.coalesce(x["m"], F.lit(0))), lambda a, b: a + b)
        kept = F.filter(F.arrays_zip(r.alias("r"), ends.alias("at")), lambda x: F.length(x["r"]["v"]) >= least)
        at = lambda x: x["at"] + x["r"]["p"]
        return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), at(x).alias("start"), (at(x) + x["r"]["m"]).alias("end"), x["r"]["v"].alias("value")))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(F.rlike(text, F.lit(quick)), bind(rows, spans)).otherwise(empty)


def _rank(kind: Column, kinds: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), kind)


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", repo: Column | None = None, owner: Column | None = None, wide: int = WIDE, base=None, more=None) -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start, rank, kind, end, base, owners, repos, verdict>>, by start, then kind.

    ``repo`` and ``owner`` default to (source, lang) and source. ``verdict`` is ``example`` or ``live``; finds of
    further kinds that are examples are left out.
    """
    base, more = BASE if base is None else base, MORE if more is None else more
    kinds = [k[0] for k in [*base, *more]]
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    docs = docs.drop("secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    possible = reduce(lambda a, b: a | b, [F.rlike(text, F.lit(k[1])) for k in [*base, *more]])
    key = [F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text")]
    found = F.concat(*[find_all(F.col("t"), *k) for k in [*base, *more]])
    # the finds of each text, once for rows that repeat as far as they agree; small, as texts stay behind
    finds = docs.where(possible).select(*key, owner.alias("owner"), repo.alias("repo"), text.alias("t")).select("__id", "__text", "owner", "repo", F.explode(found).alias("f"))
    finds = materialise(finds.select("__id", "__text", "owner", "repo", "f.kind", "f.start", "f.end", F.xxhash64("f.value").alias("v"), F.sha1("f.value").alias("v2"), _mixed(F.col("f.value")).alias("mixed")), "finds")
    # first by value, owner and repository, so that a value that stands in many texts is many small groups
    held = finds.groupBy("v", "v2", "owner", "repo").agg(F.count("*").alias("n"))
    counts = held.groupBy("v", "v2").agg(F.count_distinct(F.coalesce("owner", F.lit("\0"))).alias("owners"), F.count_distinct(F.struct(F.coalesce("owner", F.lit("\0")), F.coalesce("repo", F.lit("\0")))).alias("repos"))
    judged = finds.join(counts, ["v", "v2"])
    is_base = F.col("kind").isin([k[0] for k in base])
    live = (F.col("owners") < wide) & F.col("mixed")
    span = F.struct("start", _rank(F.col("kind"), kinds).alias("rank"), "kind", "end", is_base.alias("base"), "owners", "repos", F.when(live, "live").otherwise("example").alias("verdict"))
    spans = judged.where(is_base | live).groupBy("__id", "__text").agg(F.array_sort(F.collect_set(span)).alias("__secrets"))
    spans = materialise(spans, "spans").withColumnsRenamed({"__id": "__id2", "__text": "__text2"})
    empty = F.array().cast(spans.schema["__secrets"].dataType)
    some = docs.where(possible).withColumn("__text", F.xxhash64(text))
    some = some.join(spans, F.col(id_col).eqNullSafe(F.col("__id2")) & (F.col("__text") == F.col("__text2")), "left")
    some = some.select(*docs.columns, F.coalesce("__secrets", empty).alias("secrets"))
    return some.unionByName(docs.where(~possible).withColumn("secrets", empty))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans (sorted by start) replaced by ``mark``. The text is cut into pieces first, so that
    no span is looked for from the text's beginning."""
    none = F.array().cast("array<string>")

    def part(pieces: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        at = begin % PIECE + 1
        within = F.substring(F.get(pieces, first), at, end - begin)
        across = F.concat(F.substring(F.get(pieces, first), at, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(F.get(pieces, last), F.lit(1), (end - 1) % PIECE + 1))
        return F.when(end <= begin, "").when(first == last, within).otherwise(across)

    def done(pieces: Column) -> Column:
        def join(rows: Column) -> Column:
            apart = F.filter(rows, lambda r: r["s"]["start"] >= r["before"])
            kept = F.transform(apart, lambda r: F.concat(part(pieces, r["before"], r["s"]["start"]), F.lit(mark)))
            tail = part(pieces, F.array_max(F.transform(rows, lambda r: r["s"]["end"])), F.length(text))
            return F.array_join(F.concat(kept, F.array(tail)), "")

        before = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return bind(F.arrays_zip(spans.alias("s"), before.alias("before")), join)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bind(F.coalesce(pieces, none), done)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`scan_secrets` for each document: counts, spans, and for each span its verdict and how many owners and
    repositories its value has in the corpus."""
    out = scan_secrets(docs.select("doc_id", "text", "source", "lang")).select("doc_id", "secrets")
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, place), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", place), ",").alias("spans"),
        F.array_join(F.transform("secrets", lambda s: s["verdict"]), ",").alias("verdicts"),
        F.array_join(F.transform("secrets", lambda s: s["owners"].cast("string")), ",").alias("owners"),
        F.array_join(F.transform("secrets", lambda s: s["repos"].cast("string")), ",").alias("repositories"),
        F.size(F.filter("secrets", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
    )
