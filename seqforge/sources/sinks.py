"""Sinks: models, predictions, reports, folds and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.operators.model import SequenceModel


def write_steps(model: SequenceModel, spark: SparkSession, path: str) -> None:
    """Lines ``step ngram`` with 17 decimals, in order."""
    rows = [(i, f"{s:.17f} {g}") for i, (s, g) in enumerate(model.steps)]
    spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def model_lines(model: SequenceModel) -> list[str]:
    rules = sorted(model.weights.items(), key=lambda x: (-x[1], x[0]))
    return [f"{model.bias:.24g}", f"{model.intercept:.24g} INTERCEPT", *(f"{w:.24g} {g}" for g, w in rules)]


def write_model(model: SequenceModel, spark: SparkSession, path: str) -> None:
    """Bias, intercept, then the rules by falling weight."""
    rows = list(enumerate(model_lines(model)))
    spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def save_model(model: SequenceModel, spark: SparkSession, path: str) -> None:
    """The model as Parquet: a row for each step, and before them one of the scalars, whose step is null."""
    scalars = (float(model.bias), model.words, model.bytes, *model.gaps)
    rows = [(-1, None, None, *scalars), *((i, float(s), g, *[None] * len(scalars)) for i, (s, g) in enumerate(model.steps))]
    spark.createDataFrame(rows, "itr int, step double, ngram string, bias double, words boolean, bytes boolean, total_gap int, run_gap int").write.parquet(path)


def open_model(spark: SparkSession, path: str, threshold: float | None = None) -> SequenceModel:
    """A saved model; a threshold replaces its bias by the negated threshold."""
    first, *steps = spark.read.parquet(path).orderBy("itr").collect()  # a row for each learning step
    model = SequenceModel([(r["step"], r["ngram"]) for r in steps], first["bias"], first["words"], (first["total_gap"], first["run_gap"]), first["bytes"])
    if threshold is not None:
        model.bias = -threshold
    return model


def predictions(scored: DataFrame, verbosity: int = 1) -> DataFrame:
    """The line of each prediction: the score; label, score, probability and text; the same with the rules matched; or
    the label with sparse feature ids."""
    needed = {4: "rules", 5: "ids"}.get(verbosity)
    if verbosity not in (1, 2, 4, 5) or needed and needed not in scored.columns:
        raise ValueError(f"verbosity {verbosity} is not one of 1, 2, 4, 5, or its column {needed} is missing")
    base = F.concat_ws(" ", F.col("y").cast("string"), F.col("score").cast("string"), F.col("probability").cast("string"), "seq")
    line = {1: F.col("score").cast("string"), 2: base, 4: F.concat(base, F.lit(" <instance> "), F.array_join("rules", " "), F.lit(" </instance>")) if verbosity == 4 else base, 5: F.concat_ws(" ", F.col("y").cast("string"), F.array_join(F.transform("ids", lambda i: F.concat(i.cast("string"), F.lit(":1.0"))), " ")) if verbosity == 5 else base}
    return scored.select("doc_id", line[verbosity].alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.json(path)


def write_log(spark: SparkSession, log: DataFrame, path: str) -> None:
    """An iteration log with its header, in the order of the iterations."""
    log.coalesce(1).sortWithinPartitions("Iteration").write.csv(path, header=True)


def write_predictions(scored: DataFrame, path: str, verbosity: int = 1) -> None:
    """The lines of :func:`predictions`, in the order of doc_id."""
    predictions(scored, verbosity).orderBy("doc_id").select("value").write.text(path)


def write_truth(planted: DataFrame, docs: DataFrame, path: str) -> None:
    """The generator's ground truth: lines ``motif weight`` and, for each sequence, the motifs that it holds."""
    planted.coalesce(1).sortWithinPartitions("motif_id").select(F.concat_ws(" ", "motif", F.col("weight").cast("string")).alias("value")).write.text(f"{path}/correctModel")
    docs.orderBy("doc_id").select(F.array_join("contains", " ").alias("value")).write.text(f"{path}/contains")


def write_folds(folds: DataFrame, path: str) -> None:
    folds.write.partitionBy("fold", "split").csv(path, header=True)


def train_lines(docs: DataFrame) -> DataFrame:
    """Lines ``+label sequence``."""
    return docs.select(F.concat_ws(" ", F.concat(F.lit("+"), F.col("label").cast("string")), "seq").alias("value"))


def write_submission(predicted: DataFrame, path: str) -> None:
    """Id, array type and 2 to the power of the prediction, tab-separated and compressed."""
    out = predicted.select(F.col("id").alias("TF_Id"), F.col("array_type").alias("ArrayType"), F.pow(F.lit(2.0), "prediction").alias("Signal_Mean"))
    out.write.option("sep", "\t").option("header", True).csv(path, compression="gzip")
