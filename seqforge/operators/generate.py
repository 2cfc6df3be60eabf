"""Toy sequences with planted motifs, replayable from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The symbols, of which the first k are an alphabet.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345"


def _uniform(*keys: Column) -> Column:
    """In (0, 1), from the keys alone."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def _normal(*keys: Column) -> Column:
    u, v = _uniform(*keys, F.lit("u")), _uniform(*keys, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def motifs(spark: SparkSession, n: int, size: int, alphabet: int = 4, seed: int = 0, spread: float = 5.0) -> DataFrame:
    """motif_id, motif and weight (normal with the standard deviation ``spread``); equal motifs are left out."""
    ids = spark.range(n).withColumnRenamed("id", "motif_id")
    symbol = lambda i: F.substring(F.lit(SYMBOLS[:alphabet]), (F.floor(_uniform(F.lit(seed), F.lit("motif"), F.col("motif_id"), i) * alphabet) + 1).cast("int"), F.lit(1))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), symbol), "")
    out = ids.select("motif_id", text.alias("motif"), (spread * _normal(F.lit(seed), F.lit("weight"), F.col("motif_id"))).alias("weight"))
    return out.groupBy("motif").agg(F.min("motif_id").alias("motif_id"), F.min_by("weight", "motif_id").alias("weight")).select("motif_id", "motif", "weight")


def repaired(seq: Column, motif: str, others: list[str], alphabet: int) -> Column:
    """``seq`` without ``motif``, where that can be: in each occurrence one symbol becomes the next of the alphabet, at the first
    place at which the result holds none of the motifs."""
    def broken(i: int) -> str:
        return motif[:i] + SYMBOLS[(SYMBOLS.index(motif[i]) + 1) % alphabet] + motif[i + 1 :]

    fits = [broken(i) for i in range(len(motif)) if not any(m in broken(i) for m in [motif, *others])]
    for _ in range(2):  # an occurrence that overlaps one is left by the first turn
        seq = F.replace(seq, F.lit(motif), F.lit(fits[0] if fits else motif))
    return seq


def toy_sequences(spark: SparkSession, n: int = 200, length: int = 50, alphabet: int = 4, planted: DataFrame | None = None, seed: int = 0, noise: float = 1.0, test_every: int = 4, repair: bool = False, insert: bool = False) -> DataFrame:
    """doc_id, seq, y, contains and test: uniform sequences into which each motif is written (with ``insert``: put in between the
    symbols) with probability 1/2; with ``repair``, a motif that was not chosen is broken up where it turns up by chance. y is
    the sum of the weights of the motifs that the sequence holds in the end, plus noise, so labels and sequences agree
    either way. One sequence in ``test_every`` is a test sequence."""
    motif_rows = [] if planted is None else [tuple(r) for r in planted.select("motif_id", "motif", "weight").orderBy("motif_id").collect()]  # a handful
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    letters = F.lit(SYMBOLS[:alphabet])
    symbol = lambda i: F.substring(letters, (F.floor(_uniform(F.lit(seed), F.col("doc_id"), i) * alphabet) + 1).cast("int"), F.lit(1))
    out = ids.withColumn("seq", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), symbol), ""))
    put = {k: _uniform(F.lit(seed), F.lit("put"), F.col("doc_id"), F.lit(k)) < 0.5 for k, _, _ in motif_rows}
    if repair:
        for k, motif, _ in motif_rows:
            out = out.withColumn("seq", F.when(put[k], F.col("seq")).otherwise(repaired(F.col("seq"), motif, [m for _, m, _ in motif_rows if m != motif], alphabet)))
    for k, motif, _ in motif_rows:
        at = (F.floor(_uniform(F.lit(seed), F.lit("at"), F.col("doc_id"), F.lit(k)) * (length - len(motif) + 1)) + 1).cast("int")
        out = out.withColumn("seq", F.when(put[k], F.overlay("seq", F.lit(motif), at, F.lit(0 if insert else len(motif)))).otherwise(F.col("seq")))
    if repair:  # writing motifs may have made others
        for k, motif, _ in motif_rows:
            out = out.withColumn("seq", F.when(put[k], F.col("seq")).otherwise(repaired(F.col("seq"), motif, [m for _, m, _ in motif_rows if m != motif], alphabet)))
    held = F.filter(F.array(*[F.struct(F.lit(m).alias("motif"), F.lit(w).alias("weight")) for _, m, w in motif_rows]), lambda m: F.contains(F.col("seq"), m["motif"])) if motif_rows else None
    if held is None:
        contains, total = F.array().cast("array<string>"), F.lit(0.0)
    else:
        contains, total = F.transform(held, lambda m: m["motif"]), F.aggregate(held, F.lit(0.0), lambda a, m: a + m["weight"])
    y = total + noise * _normal(F.lit(seed), F.lit("noise"), F.col("doc_id"))
    return out.withColumns({"y": y, "contains": contains, "test": F.col("doc_id") % test_every == 0})


def recovered(planted: DataFrame, weights: DataFrame) -> DataFrame:
    """For each planted motif: the learned n-grams that are part of it or hold it, and the sum of their weights."""
    overlap = F.contains("motif", "ngram") | F.contains("ngram", "motif")  # two tables of a handful of rows
    return planted.withColumnRenamed("weight", "true_weight").join(weights, overlap, "left").groupBy("motif_id", "motif", "true_weight").agg(F.count("ngram").alias("n_rules"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("learned"))
