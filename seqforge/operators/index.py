"""Inverted index, support, and n-grams by one-token extension."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqforge.functions import text as T


def occurrences(docs: DataFrame, words: bool = False) -> DataFrame:
    """doc_id, pos (from 0) and tok of each token."""
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("seq"), words)).alias("pos", "tok"))


def following(occ: DataFrame) -> DataFrame:
    """Occurrences with the token after each, ``next`` (null at a document's end); a document is a window."""
    return occ.withColumn("next", F.lead("tok").over(Window.partitionBy("doc_id").orderBy("pos")))


def inverted_index(docs: DataFrame, words: bool = False) -> DataFrame:
    """For each token and document the token's places. A row for each token alone would gather a frequent token's whole
    posting list in one cell; by document it stays bounded by the document."""
    return occurrences(docs, words).groupBy("tok", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("places"))


def support(docs: DataFrame, words: bool = False, minsup: int = 1) -> DataFrame:
    """Number of documents of each token; tokens of less support than ``minsup`` are left out."""
    distinct = docs.select(F.explode(F.array_distinct(T.tokens(F.col("seq"), words))).alias("tok"))
    return distinct.groupBy("tok").agg(F.count("*").alias("support")).where(F.col("support") >= minsup)


def first_level(docs: DataFrame, words: bool = False) -> DataFrame:
    """doc_id, toks and variants, as :func:`children` takes them: arrays of names, of which the i-th is an n-gram that ends with
    the i-th token, or null. A document's postings stay in its row, so extending them needs no join."""
    return docs.select("doc_id", T.tokens(F.col("seq"), words).alias("toks")).withColumn("variants", F.array("toks"))


def children(frontier: DataFrame, words: bool = False, wildcard: bool = False) -> DataFrame:
    """The frontier with each n-gram extended by the next token, and with ``wildcard`` also by a wildcard in the next place;
    occurrences at a document's end drop out."""
    sep, n, none = F.lit(" " if words else ""), F.size("toks"), F.array(F.lit(None).cast("string"))
    follow = F.slice("toks", 2, F.greatest(n - 1, F.lit(0)))

    def with_token(v: Column) -> Column:
        return F.slice(F.concat(none, F.zip_with(F.slice(v, 1, F.greatest(n - 1, F.lit(0))), follow, lambda g, t: F.concat(g, sep, t))), 1, n)

    def with_wildcard(v: Column) -> Column:
        return F.slice(F.concat(none, F.transform(v, lambda g: F.concat(g, sep, F.lit(T.WILD)))), 1, n)

    found = F.transform("variants", with_token)
    return frontier.withColumn("variants", F.concat(found, F.transform("variants", with_wildcard)) if wildcard else found)


def postings(frontier: DataFrame) -> DataFrame:
    """ngram, doc_id and end_pos of a frontier."""
    rows = frontier.select("doc_id", F.explode("variants").alias("v"))
    return rows.select("doc_id", F.posexplode("v").alias("end_pos", "ngram")).where(F.col("ngram").isNotNull()).select("ngram", "doc_id", "end_pos")


def occurrence_counts(frontier: DataFrame, words: bool = False, known: DataFrame | None = None) -> DataFrame:
    """ngram, n (occurrences) and support (documents) of a frontier's n-grams; ``known``: tokens that may end one (a wildcard
    may in any case). Documents are told apart in their own rows, by their n-grams' names alone, which are hashed; what is
    shuffled is partial sums."""
    rows = frontier.select(F.array_compact(F.flatten("variants")).alias("names"))
    every = rows.select(F.explode("names").alias("ngram"), F.lit(1).alias("n"), F.lit(0).alias("support"))
    once = rows.select(F.explode(F.array_distinct("names")).alias("ngram"), F.lit(0).alias("n"), F.lit(1).alias("support"))
    out = every.unionByName(once).groupBy("ngram").agg(F.sum("n").alias("n"), F.sum("support").alias("support"))
    if known is None:
        return out
    last = F.substring_index("ngram", " ", -1) if words else F.right("ngram", F.lit(1))
    wild = known.sparkSession.range(1).select(F.lit(T.WILD).alias("tok"))
    return out.withColumn("tok", last).join(known.select("tok").unionByName(wild), "tok", "left_semi").drop("tok")


def shrink(found: DataFrame) -> DataFrame:
    """Postings without places: the distinct documents of each n-gram."""
    return found.select("ngram", "doc_id").distinct()


def wildcards(ngram: Column, words: bool) -> tuple[Column, Column]:
    """How many wildcards an n-gram has, and the longest run of them."""
    toks = F.split(ngram, " " if words else "")
    is_wild = F.transform(toks, lambda t: F.when(t == T.WILD, 1).otherwise(0))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
    step = lambda a, w: F.struct(((a["run"] + 1) * w).alias("run"), F.greatest(a["most"], (a["run"] + 1) * w).alias("most"))
    return F.aggregate(is_wild, F.lit(0), lambda a, w: a + w), F.aggregate(is_wild, start, step, lambda a: a["most"])


def within_gaps(grams: DataFrame, total: int, run: int, words: bool = False) -> DataFrame:
    """``grams`` (ngram) that keep to the wildcard limits."""
    n_wild, longest = wildcards(F.col("ngram"), words)
    total, run = T.gap_limits(total, run)
    return grams.where((n_wild <= total) & (longest <= run))


def _prefix(words: bool, length: int, gram: Column) -> Column:
    return F.substring_index(gram, " ", length) if words else F.substring(gram, 1, length)


def _with_parent(grams: Column, prefix: Callable[[Column], Column], parents: list[str]) -> Column:
    return F.filter(grams, lambda g: prefix(g).isin(parents))


def grams_of(docs: DataFrame, size: int, words: bool = False, gaps: tuple[int, int] = (0, 0), toks: str | None = None, parents: list[str] | None = None) -> DataFrame:
    """``docs`` by distinct n-gram of one size, with ``parent``: the longest proper prefix that ends in a token. Repeats
    inside a document are dropped in its own row, without a shuffle. A column ``bare`` of the documents is used where it is faster.
    ``parents``: only n-grams with one of these as their parent, sorted out in the row before anything is made of them."""
    toks = T.tokens(F.col("seq"), words) if toks is None else F.col(toks)
    bare = F.col("bare") if "bare" in docs.columns else None
    out = None
    for mask in T.masks(size, *T.gap_limits(*gaps)):
        length = max((i for i in range(1, size) if not mask[i - 1]), default=0)
        prefix = partial(_prefix, words, length)
        grams = T.mask_grams(toks, mask, words, bare)
        if parents is not None:
            grams = _with_parent(grams, prefix, parents)
        part = docs.select(*[c for c in docs.columns if c != "ngram"], F.explode(F.array_distinct(grams)).alias("ngram"))
        part = part.withColumn("parent", prefix(F.col("ngram")))
        out = part if out is None else out.unionByName(part)
    return out
