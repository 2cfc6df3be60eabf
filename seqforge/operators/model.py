"""Linear sequence models: roll-up of learning steps, norms, scoring and matched rules."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.functions import text as T
from seqforge.functions.loss import probability
from seqforge.operators import evaluate, matcher

#: Fixed value: the key of the intercept's steps.
INTERCEPT = "*INTERCEPT*"


@dataclass
class SequenceModel:
    """Steps (step, ngram) in learning order; wildcards in n-grams are kept as ``T.WILD``."""

    steps: list[tuple[float, str]] = field(default_factory=list)
    bias: float = 0.0
    words: bool = False
    gaps: tuple[int, int] = (0, 0)
    bytes: bool = False

    def add(self, step: float, ngram: str) -> None:
        self.steps.append((step, ngram))

    @property
    def weights(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for step, g in self.steps:
            if g != INTERCEPT:
                out[g] = out.get(g, 0.0) + step
        return out

    @property
    def intercept(self) -> float:
        return sum(s for s, g in self.steps if g == INTERCEPT)

    @property
    def norms(self) -> tuple[float, float]:
        """Sum of the absolute steps, and the root of the squared weights."""
        return sum(abs(s) for s, _ in self.steps), sum(w * w for w in self.weights.values()) ** 0.5

    def rules(self, spark) -> DataFrame:
        return spark.createDataFrame([(g, float(w)) for g, w in self.weights.items()], "ngram string, weight double")

    def transform(self, docs: DataFrame, with_rules: bool = False) -> DataFrame:
        return score(docs, list(self.weights.items()), self.bias + self.intercept, self.words, with_rules, self.bytes)

    def tune(self, docs: DataFrame) -> tuple[float, int]:
        """Replace the bias by the threshold, negated, that makes the fewest errors on ``docs`` (doc_id, seq, y); both are returned."""
        raw = score(docs, list(self.weights.items()), self.intercept, self.words, as_bytes=self.bytes)
        found = evaluate.tune(raw).first()
        threshold = max(found["threshold"], -sys.float_info.max)
        self.bias = -threshold
        return threshold, found["errors"]


def roll_up(steps: DataFrame) -> DataFrame:
    """ngram and weight: the sum of the steps of each n-gram."""
    return steps.groupBy("ngram").agg(F.sum("step").alias("weight"))


def norms(steps: DataFrame) -> DataFrame:
    """l1 over all steps, l2 over the weights of n-grams, and the intercept, in one row."""
    l1 = steps.agg(F.sum(F.abs("step")).alias("l1"))
    weights = roll_up(steps).agg(F.sqrt(F.sum(F.when(F.col("ngram") != INTERCEPT, F.col("weight") * F.col("weight")).otherwise(0.0))).alias("l2"), F.sum(F.when(F.col("ngram") == INTERCEPT, F.col("weight")).otherwise(0.0)).alias("intercept"))
    return l1.crossJoin(weights)  # one row each


def normalised(weights: DataFrame, l1: float) -> DataFrame:
    return weights.withColumn("weight", F.col("weight") / F.lit(l1))


def known(rules: DataFrame | list[tuple[str, float]]) -> list[tuple[str, float]]:
    return [(r["ngram"], float(r["weight"])) for r in rules.select("ngram", "weight").collect()] if isinstance(rules, DataFrame) else rules


def with_matches(docs: DataFrame, rules: DataFrame | list[tuple[str, float]], words: bool = False, as_bytes: bool = False) -> DataFrame:
    """``docs`` with ``__hits``: the distinct rules (ngram, weight) that a document holds, in the order of their n-grams. Rules
    come from learning steps, so they fit the driver; one walk down their prefix tree finds them (:mod:`matcher`)."""
    return docs.withColumn("__hits", matcher.matched(T.bare(T.symbols(F.col("seq"), as_bytes), words), known(rules), words))


def matches(docs: DataFrame, rules: DataFrame | list[tuple[str, float]], words: bool = False, as_bytes: bool = False) -> DataFrame:
    """doc_id, ngram and weight of each distinct rule that a document holds."""
    return with_matches(docs, rules, words, as_bytes).select("doc_id", F.explode("__hits").alias("r")).select("doc_id", "r.ngram", "r.weight")


def score(docs: DataFrame, rules: DataFrame | list[tuple[str, float]], offset: float, words: bool = False, with_rules: bool = False, as_bytes: bool = False) -> DataFrame:
    """``docs`` with score, probability and n_rules, and with ``rules`` (n-grams in order) if asked for; all in the row."""
    if not with_rules:  # the sums alone leave a task: a document may hold thousands of rules
        total = matcher.summed(T.bare(T.symbols(F.col("seq"), as_bytes), words), known(rules), words, float(offset))
        out = docs.withColumn("__total", total).withColumns({"score": F.col("__total.score"), "n_rules": F.col("__total.n_rules")})
        return out.withColumn("probability", probability(F.col("score"))).drop("__total")
    out = with_matches(docs, rules, words, as_bytes)
    total = F.aggregate("__hits", F.lit(float(offset)), lambda a, r: a + r["weight"])
    out = out.withColumns({"score": total, "n_rules": F.size("__hits").cast("long")}).withColumn("probability", probability(F.col("score")))
    name = T.byte_name if as_bytes else T.shown
    return out.withColumn("rules", F.sort_array(F.transform("__hits", lambda r: name(r["ngram"])))).drop("__hits")


def unmatched(scored: DataFrame) -> DataFrame:
    """Documents that hold none of the model's n-grams."""
    return scored.where("n_rules = 0")


def count_unmatched(scored: DataFrame) -> DataFrame:
    """How many documents hold none of the model's n-grams, and how many there are; one row."""
    return scored.agg(F.count_if(F.col("n_rules") == 0).alias("n_oov"), F.count("*").alias("n"))
