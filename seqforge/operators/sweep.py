"""Sweeps: the same experiment over a grid of settings (a loop on the driver, with a row of measures for each cell), or over
groups of documents (one learning run, whatever the number of groups)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.operators import baselines, evaluate, generate
from seqforge.operators.learn import LearnConfig, Learned, learn, learn_many
from seqforge.operators.model import with_matches
from seqforge.session import materialise


def alphabet_sweep(spark: SparkSession, config: LearnConfig, alphabets: Iterable[int] = (2, 4, 8, 16, 32), runs: int = 5, n: int = 10_000, length: int = 5000, motif: int = 5, n_motifs: int = 2, baseline: str = "ridge", sizes: range = range(1, 4)) -> DataFrame:
    """alphabet, run, method and the regression measures on test sequences, of learning and of a bag-of-n-gram baseline."""
    out = None
    for k in alphabets:
        for run in range(runs):
            planted = generate.motifs(spark, n_motifs, motif, k, seed=run)
            docs = materialise(generate.toy_sequences(spark, n, length, k, planted, seed=run), "toy")
            train, test = docs.where("not test"), docs.where("test")
            learned = learn(train, replace(config)).model.transform(test)
            # the vocabulary is that of all sequences; the weights are those of the training sequences
            rows, _ = baselines.vectorise(docs, sizes)
            fitted = baselines.fit(baseline, rows.where("not test"), train.count()).transform(rows.where("test")).withColumnRenamed("prediction", "score")
            for method, scored in (("learned", learned), (baseline, fitted)):
                part = evaluate.regression(scored.select("score", "y")).select(F.lit(k).alias("alphabet"), F.lit(run).alias("run"), F.lit(method).alias("method"), "*")
                out = part if out is None else out.unionByName(part)
    return out


def learn_groups(docs: DataFrame, config: LearnConfig) -> dict[str, Learned]:
    """A model for each group of ``docs`` (doc_id, grp, seq, y), in the jobs of one learning run. A group's mean response is taken off and
    is its model's bias."""
    means = {r["grp"]: r["mean"] for r in docs.groupBy("grp").agg(F.avg("y").alias("mean")).collect()}
    table = docs.sparkSession.createDataFrame([(g, m or 0.0) for g, m in means.items() if g is not None], "grp string, mean double")
    # a row for each model
    centred = docs.join(F.broadcast(table), "grp").withColumn("y", F.col("y") - F.col("mean"))
    found = learn_many(centred, config, ["y"], "grp", {(g, 0): m or 0.0 for g, m in means.items()})
    return {grp: learned for (grp, _), learned in found.items()}


def score_groups(docs: DataFrame, models: dict[str, Learned], model_of: str = "grp") -> DataFrame:
    """``docs`` (doc_id, seq and the column that names its model) with score, each row by its own model: all models' rules are looked for in one
    walk, and a row adds up the weights of its own."""
    names = sorted({g for x in models.values() for g in x.model.weights})
    some = next(iter(models.values()), None)
    hits = with_matches(docs, [(g, 0.0) for g in names], some.model.words if some else False, some.model.bytes if some else False)
    # as many rows as models, with as many weights as learning steps
    table = [(grp, float(x.model.bias + x.model.intercept), {g: float(w) for g, w in x.model.weights.items()}) for grp, x in models.items()]
    weights = docs.sparkSession.createDataFrame(table, "__grp string, __offset double, __weights map<string,double>")
    out = hits.join(F.broadcast(weights), F.col(model_of) == F.col("__grp"))
    total = F.aggregate("__hits", F.col("__offset"), lambda a, r: a + F.coalesce(F.element_at("__weights", r["ngram"]), F.lit(0.0)))
    return out.withColumn("score", total).drop("__hits", "__grp", "__offset", "__weights")


def transfer_sweep(docs: DataFrame, kinds: tuple[str, str], config: LearnConfig) -> DataFrame:
    """For each group of ``docs`` (doc_id, group, kind, seq, y) and both directions: doc_id, group, trained_on, y and score of one
    kind's documents by a model of the other kind's. All groups and directions are models of one learning run."""
    key = lambda kind: F.concat(kind, F.lit("/"), F.col("group").cast("string"))
    rows = docs.where(F.col("kind").isin(*kinds))
    models = learn_groups(rows.withColumn("grp", key(F.col("kind"))), config)
    other = F.when(F.col("kind") == kinds[0], kinds[1]).otherwise(kinds[0])
    scored = score_groups(rows.withColumn("trained_on", other).withColumn("grp", key(F.col("trained_on"))), models)
    return scored.select("doc_id", "group", "trained_on", "y", "score")
