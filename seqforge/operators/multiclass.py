"""One-vs-rest learning over several classes, and the choice among their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.functions import loss as L
from seqforge.functions import text as T
from seqforge.operators.learn import LearnConfig, Learned, learn_many
from seqforge.operators.index import grams_of
from seqforge.operators.model import SequenceModel, with_matches
from seqforge.sources.labelled import one_vs_rest


def learn_classes(docs: DataFrame, classes: list[int], config: LearnConfig) -> dict[int, Learned]:
    """A model for each class, of ``docs`` (doc_id, seq, label): the classes are responses of one learning run, so each level of the search is one
    pass with a gradient for every class, and an n-gram is extended if any class asks for it."""
    rows = docs.withColumns({f"y{k}": one_vs_rest(F.col("label"), k) for k in classes})
    found = learn_many(rows, config, [f"y{k}" for k in classes])
    return {k: found.get(("", r), Learned(SequenceModel())) for r, k in enumerate(classes)}


def fold_predictions(docs: DataFrame, classes: list[int], config: LearnConfig, folds: int) -> DataFrame:
    """One-vs-rest over folds: ``docs`` (doc_id, seq, label, fold) with ``predicted``, each fold by models of the others."""
    out = None
    for k in range(folds):
        models = learn_classes(docs.where(F.col("fold") != k), classes, config)
        part = predict_models(docs.where(F.col("fold") == k), models)
        out = part if out is None else out.unionByName(part)
    return out


def predict(docs: DataFrame, weights: dict[int, dict[str, float]], offsets: dict[int, float] | None = None, words: bool = False, as_bytes: bool = False) -> DataFrame:
    """``docs`` with ``predicted``, the class whose score is largest (to nine digits; ties to the smallest). The rules of all classes are looked for
    at once and added up by class in the document's own row."""
    classes, names = sorted(weights), sorted({g for own in weights.values() for g in own})
    hits = with_matches(docs, [(g, 0.0) for g in names], words, as_bytes)

    def scored(k: int):
        own = [(g, w) for g, w in sorted(weights[k].items())]
        start = F.lit(float((offsets or {}).get(k, 0.0)))
        if not own:
            return start
        table = F.create_map(*[F.lit(x) for g, w in own for x in (g, float(w))])
        return F.aggregate("__hits", start, lambda a, r: a + F.coalesce(F.element_at(table, r["ngram"]), F.lit(0.0)))

    best = F.array_max(F.array(*[F.struct(F.round(scored(k), 9).alias("score"), F.lit(-k).alias("k")) for k in classes]))
    return hits.withColumn("predicted", (-best["k"]).cast("int")).drop("__hits")


def predict_models(docs: DataFrame, models: dict[int, Learned]) -> DataFrame:
    """:func:`predict` by learned models."""
    some = next(iter(models.values())).model
    return predict(docs, {k: x.model.weights for k, x in models.items()}, {k: x.model.bias + x.model.intercept for k, x in models.items()}, some.words, some.bytes)


def class_gradients(docs: DataFrame, classes: list[int], size: int, config: LearnConfig) -> DataFrame:
    """The gradient of each n-gram of a size for all classes at f = 0, in one pass: a column for each class."""
    pulls = [L.pull(config.objective, one_vs_rest(F.col("label"), k), F.lit(0.0)).alias(f"g{k}") for k in classes]
    rows = grams_of(docs.select(T.tokens(F.col("seq"), config.words).alias("toks"), T.bare(F.col("seq"), config.words).alias("bare"), *pulls), size, config.words, config.gaps, "toks")
    return rows.groupBy("ngram").agg(F.count("*").alias("support"), *[(-F.sum(f"g{k}")).alias(f"class{k}") for k in classes])


def confusion(predicted: DataFrame, classes: list[int]) -> DataFrame:
    """A row for each true class and a column for each predicted one."""
    table = predicted.groupBy("label").pivot("predicted", classes).agg(F.count(F.lit(1)))
    return table.select("label", *[F.coalesce(F.col(str(k)), F.lit(0).cast("long")).alias(f"p{k}") for k in classes])


def fold_accuracy(predicted: DataFrame) -> DataFrame:
    """Accuracy of each fold and, with fold null, of all."""
    right = F.when(F.col("label") == F.col("predicted"), 1.0).otherwise(0.0)
    return predicted.rollup("fold").agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))
