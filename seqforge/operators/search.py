"""Search for the n-gram with the largest gradient, level by level, with branch-and-bound pruning.

A document's row holds its tokens, response and score, so that a level needs neither a positional join nor a join with
the residuals: a row explodes into its distinct n-grams of one size whose parent has survived, with the document's share
of the gradient, and one aggregation with partial sums gives gradient, bounds and support. The survivors' names are
counted first: up to ``IN_ROW`` of them go into the rows' own test, more are joined after the explosion. What comes to the
driver for a level is its best rows and counts. An n-gram is expanded only if the gradient that any extension of it can have
exceeds the best found, and its support reaches ``minsup``; the winner is that of an exhaustive search. The best rows of one
search are candidates of the next: the largest gradient that one of them has there prunes it from the start.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import loss as L
from seqforge.functions import text as T
from seqforge.operators.index import grams_of
from seqforge.session import materialise


@dataclass
class SearchConfig:
    """``words``: tokens are words, else characters, or with ``bytes`` the UTF-8 bytes. ``traversal``, of a search that is kept: ``bfs``,
    ``dfs`` or ``best`` (the largest bound first); all have the same winner."""

    objective: str = "squared"
    minsup: int = 1
    minpat: int = 1
    maxpat: int = 1 << 30
    gaps: tuple[int, int] = (0, 0)
    words: bool = False
    c: float = 0.0
    alpha: float = 0.2
    traversal: str = "bfs"
    bytes: bool = False


#: Survivors up to which a row tests its n-grams for them, and n-grams of a level that are candidates of the next search.
IN_ROW, CANDIDATES = 4_000, 16


@dataclass
class Found:
    """The best n-gram; ``counters`` has candidates, survivors and those with a corrected bound of each level, ``near`` the best of
    each level."""

    ngram: str | None = None
    size: int = 0
    gradient: float = 0.0
    support: int = 0
    counters: list[tuple[int, int, int, int]] = field(default_factory=list)
    near: list[str] = field(default_factory=list)


def bounds(rows: DataFrame, keys: list[str], g: str = "g") -> DataFrame:
    """gradient, upos, uneg and support by ``keys``, for rows of distinct (n-gram, document) with the pull ``g``."""
    v = F.col(g)
    return rows.groupBy(*keys).agg(
        (-F.sum(v)).alias("gradient"),
        (-F.sum(F.when(v > 0, v).otherwise(0.0))).alias("upos"),
        (-F.sum(F.when(v > 0, 0.0).otherwise(v))).alias("uneg"),
        F.count("*").alias("support"),
    )


def selected_frame(spark, weights: dict[str, float], config: SearchConfig) -> DataFrame:
    """The penalty's part of the gradient for each selected feature (as many as learning steps at most)."""
    rows = [(g, float(w), L.penalty_gradient(w, config.c, config.alpha)) for g, w in weights.items()]
    return spark.createDataFrame(rows, "ngram string, weight double, extra double")


def prefix_frame(spark, weights: dict[str, float], config: SearchConfig) -> DataFrame:
    """For each prefix of selected features the least and largest penalty part of these."""
    parts: dict[str, list[float]] = {}
    for g, w in weights.items():
        for p in [*T.prefixes(g, config.words), g]:
            parts.setdefault(p, []).append(L.penalty_gradient(w, config.c, config.alpha))
    rows = [(p, min(x), max(x)) for p, x in parts.items()]
    return spark.createDataFrame(rows, "ngram string, low double, high double")


def penalised(level: DataFrame, weights: dict[str, float] | None, config: SearchConfig) -> DataFrame:
    """``level`` with the penalty in the gradient of selected features and in the bounds of their prefixes."""
    spark = level.sparkSession
    if not weights or not config.c:
        return level.withColumns({"reach": F.greatest(F.abs("upos"), F.abs("uneg")), "rewritten": F.lit(False)})
    level = level.join(selected_frame(spark, weights, config).select("ngram", "extra"), "ngram", "left")
    level = level.join(prefix_frame(spark, weights, config), "ngram", "left")
    raw = F.greatest(F.abs("upos"), F.abs("uneg"))
    ends = [F.abs(F.col(u) + F.coalesce(F.col(e), F.lit(0.0))) for u in ("upos", "uneg") for e in ("low", "high")]
    return level.withColumns({"gradient": F.col("gradient") + F.coalesce("extra", F.lit(0.0)), "reach": F.greatest(raw, *ends), "rewritten": F.coalesce(F.greatest(*ends) > raw, F.lit(False))}).drop("extra", "low", "high")


def order_key(size: Column | int) -> list[Column]:
    """Largest gradient, then shortest, then first in byte order."""
    size = F.lit(size) if isinstance(size, int) else size
    return [F.round(F.abs("gradient"), 9).desc(), size.asc(), F.col("ngram").asc()]


def may_be_selected(ngram: str, config: SearchConfig) -> bool:
    """Whether a search with these settings can come to an n-gram: its size, its ends, and its wildcards."""
    toks = ngram.split(" ") if config.words else list(ngram)
    total, run = T.gap_limits(*config.gaps)
    runs = [len(list(x)) for wild, x in groupby(toks, T.WILD.__eq__) if wild]
    ends = bool(toks) and T.WILD not in (toks[0], toks[-1]) and "" not in toks
    return ends and max(1, config.minpat) <= len(toks) <= config.maxpat and sum(runs) <= total and max(runs, default=0) <= run


def least_gradient(state: DataFrame, config: SearchConfig, weights: dict[str, float] | None, candidates: list[str]) -> float:
    """A little less than the largest gradient among some n-grams (a former search's best) that may be selected: the winner's is
    no smaller. One aggregation without any n-grams of the documents."""
    fits = [g for g in dict.fromkeys(candidates) if may_be_selected(g, config)]
    if not fits:
        return 0.0
    row = state.agg(*[x for i, g in enumerate(fits) for has in [T.holds(F.col("bare"), g, config.words)] for x in (F.sum(F.when(has, F.col("g"))).alias(f"g{i}"), F.count_if(has).alias(f"n{i}"))]).first()
    best = 0.0
    for i, g in enumerate(fits):
        if (row[f"n{i}"] or 0) >= config.minsup:
            extra = L.penalty_gradient(weights[g], config.c, config.alpha) if weights and config.c and g in weights else 0.0
            best = max(best, abs(extra - (row[f"g{i}"] or 0.0)))
    return max(0.0, best * (1 - 1e-9) - 1e-6)


def best_ngram(state: DataFrame, config: SearchConfig, weights: dict[str, float] | None = None, tau: float = 0.0, candidates: list[str] | None = None) -> Found:
    """The best n-gram of ``state`` (toks, bare, g and what else). ``tau``: only a larger gradient counts; ``candidates``: n-grams
    of which the best prunes from the start."""
    found, alive, parents, size = Found(), None, None, 0
    rows = state.select(*(c for c in ("toks", "bare", "g") if c in state.columns))
    best_abs = max(tau, least_gradient(state, config, weights, candidates or []))
    while size < config.maxpat:
        size += 1
        # only prefixes that survived are expanded; these tables are read by the next sizes as far as wildcards reach
        grams = grams_of(rows, size, config.words, config.gaps, "toks", parents).drop("toks", "bare")
        if alive is not None and parents is None:
            grams = grams.join(alive, "parent", "left_semi")
        level = penalised(bounds(grams, ["ngram"]), weights, config)
        level = materialise(level, "level")
        wanted = level.where((F.col("support") >= config.minsup) & (F.round(F.abs("gradient"), 9) > round(best_abs, 9)))
        if size >= config.minpat:
            top = wanted.orderBy(*order_key(size)).limit(CANDIDATES).collect()
            found.near += [r["ngram"] for r in top]
            if top:
                best_abs = abs(top[0]["gradient"])
                found = Found(top[0]["ngram"], size, top[0]["gradient"], top[0]["support"], found.counters, found.near)
        lives = (F.col("support") >= config.minsup) & (F.round("reach", 9) > round(best_abs, 9))
        survivors = level.where(lives).select(F.col("ngram").alias("parent"))
        total, kept, rewritten = level.agg(F.count("*"), F.count_if(lives), F.count_if("rewritten")).first()
        found.counters.append((size, total, kept, rewritten))
        reach = T.gap_limits(*config.gaps)[1]
        if not reach:
            alive = survivors
            if not kept:
                break
            # counted, and a name is short: a bounded list
            parents = [r[0] for r in survivors.collect()] if kept <= IN_ROW and size < config.maxpat else None
        else:
            alive = survivors if alive is None else alive.unionByName(survivors)
            # a parent lies at most a run of wildcards and a token behind
            if not any(c[2] for c in found.counters[-(min(reach, size) + 1) :]):
                break
    return found


def rank_all(state: DataFrame, config: SearchConfig, sizes: int) -> DataFrame:
    """Gradient, bounds and support of every n-gram up to a size, in one pass without pruning."""
    out = None
    for size in range(1, sizes + 1):
        rows = state.select(*(c for c in ("toks", "bare", "g") if c in state.columns))
        part = bounds(grams_of(rows, size, config.words, config.gaps, "toks").drop("toks", "bare", "parent"), ["ngram"]).withColumn("size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("support") >= config.minsup)
