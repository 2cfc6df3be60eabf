"""Scores of a stream of documents by a fixed model: stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqforge.operators.model import SequenceModel


def score_stream(docs: DataFrame, model: SequenceModel) -> DataFrame:
    """``docs`` (batch or stream) with score, n_rules and probability, without an aggregation: rules are looked for in the row."""
    return model.transform(docs)


def start(docs: DataFrame, model: SequenceModel, path: str, checkpoint: str) -> StreamingQuery:
    """Score all that is there, append it to ``path`` exactly once, and stop."""
    return score_stream(docs, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
