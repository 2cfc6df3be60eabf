"""A corpus through five stages; each takes (spark, docs, sf_dir) and returns a DataFrame that the next one rereads.

Every stage but the last returns the columns of its documents, whatever these are besides doc_id, text, lang and source; a column
named like one that an operator adds inside is put back as it was. An empty table passes through all of them, repeated rows
are rows of their own except where near-duplicates go, texts are taken whole, and the docstrings say what becomes of nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.llm import decontam, near_dup, secret_scan, sp_codec, toxicity
from seqforge.session import materialise, temporary

#: The toxicity model and the encoding cannot be written as SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _through(docs: DataFrame, *taken: str) -> DataFrame:
    """``docs`` with columns that an operator would replace under other names."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in taken if c in docs.columns})


def _columns(out: DataFrame, docs: DataFrame, *taken: str) -> DataFrame:
    """The columns of ``docs``."""
    return out.drop(*taken).withColumnsRenamed({f"__own_{c}": c for c in taken}).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, learned from the labelled ones, rejects. A null or empty text is scored like
    one without any response; without labels nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*toxicity.labelled(docs, labels))
    out = toxicity.score_toxicity(_through(docs, "toxicity"), model).where(F.col("toxicity") < 0.5)
    return _columns(out, docs, "toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on shingles of five words, that with the smallest id. Documents without
    words are in no group; of rows that repeat an id, one stays; rows with a null id all stay."""
    return _columns(near_dup.keep_one(docs, size=5), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item. A null text holds none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontam.decontaminate(_through(docs, "leak"), benchmark).where(F.col("leak.n_hit") == 0)
    return _columns(out, docs, "leak")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced. A null text stays null; a null source is an owner of its own."""
    found = secret_scan.scan_secrets(_through(docs, "secrets"))
    return _columns(found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secrets"))), docs, "secrets")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and a digest of what they decode to. A null or empty text has no ids."""
    out = sp_codec.encode_decode(docs.select("doc_id", "text", "lang", "source"))
    digest = F.sha2(F.col("decoded"), 256)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", digest.alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage has written on its way is deleted when its result is; the last result stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark, keep="pipeline-sentencepiece"):
        for name, stage in STAGES:
            with temporary(spark, keep="pipeline-"):
                docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
