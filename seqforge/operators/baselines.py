"""Baselines on a bag of n-grams: least squares, ridge, elastic net and a linear support vector regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions.arrow import arrow_column, bound_batches
from seqforge.operators import evaluate
from seqforge.operators.model import INTERCEPT
from seqforge.session import materialise


def distinct_grams(seq: Column, sizes: range) -> Column:
    """array<string>: the distinct n-grams of the sizes of a text, size by size; null for null. Places are numbers of their tokens, and a name is
    made once for each n-gram of a batch."""

    def finder():
        def find(texts: pa.Array) -> pa.Array:
            held = [t.as_py() for t in texts]
            points = np.frombuffer("".join(t or "" for t in held).encode("utf-32-le"), np.uint32)
            letters, codes = np.unique(points, return_inverse=True)
            lengths = np.array([len(t or "") for t in held], np.int64)
            text = np.repeat(np.arange(len(held)), lengths)
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # tokens from a place to its text's end
            names, owners, grams = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            rank = np.zeros(len(codes), np.int64)
            for n in range(1, max(sizes, default=0) + 1):
                # the number of the n-gram at each place, from that of one less and the next token: never larger than the places squared
                at = np.flatnonzero(left >= n)
                if not len(at):
                    break
                key, first, inverse = np.unique(rank[at] * len(letters) + codes[at + n - 1], return_index=True, return_inverse=True)
                rank[at] = inverse
                if n in sizes:
                    pairs = np.unique(text[at] * len(key) + inverse)
                    owners.append(pairs // len(key))
                    grams.append(pairs % len(key) + len(names))
                    names += ["".join(map(chr, points[i : i + n].tolist())) for i in at[first].tolist()]
            owner, gram = np.concatenate(owners), np.concatenate(grams)
            order = np.argsort(owner, kind="stable")
            offsets = np.searchsorted(owner[order], np.arange(len(held) + 1)).astype(np.int32)
            values = pa.array(names, pa.string()).take(pa.array(gram[order]))
            return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([t is None for t in held]))

        return find

    return arrow_column(finder, "array<string>", seq)


def vectorise(docs: DataFrame, sizes: range) -> tuple[DataFrame, list[str]]:
    """``docs`` with sparse binary ``features`` of all character n-grams of the sizes, lower-cased, these n-grams as ``grams``, and their names,
    those of most documents first. The n-grams are found once and written; none is left out, so the fitted weights of all of them are
    held by the driver."""
    rows = materialise(docs.withColumn("grams", distinct_grams(F.lower("seq"), sizes)), "grams")
    counted = rows.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    names = [r["g"] for r in counted.orderBy(F.desc("n"), "g").collect()]  # as many as features
    fitted = CountVectorizerModel.from_vocabulary(names or [""], inputCol="grams", outputCol="features").setBinary(True)
    return fitted.transform(rows), names


#: Features up to which the library solves by the normal equations; and when a fit has converged, so that it is not ended by its iterations.
NORMAL, TOLERANCE, MOST = 4096, 1e-9, 10_000


def fit(kind: str, rows: DataFrame, n: int):
    """A fitted ``ols``, ``ridge`` (penalty 1 on the sum of squares) or ``enet`` (1, half L1). The library scales responses to a
    deviation of one, which divides the squared part of a penalty by their deviation; it is multiplied by that here. The deviation is that of the rows in the
    normal equations, and that of a sample in the other solver."""
    normal = rows.select("features").first()[0].size <= NORMAL
    size = rows.agg((F.stddev_pop if normal else F.stddev_samp)("y")).first()[0] or 1.0
    l1, l2 = {"ols": (0.0, 0.0), "ridge": (0.0, size / n), "enet": (0.5, 0.5 * size)}[kind]
    options = {"regParam": l1 + l2, "elasticNetParam": l1 / (l1 + l2) if l1 else 0.0}
    solver = "normal" if normal else "l-bfgs"
    return LinearRegression(featuresCol="features", labelCol="y", standardization=False, solver=solver, tol=TOLERANCE, maxIter=MOST, **options).fit(rows)


def sparse(rows: DataFrame, names: list[str]) -> DataFrame:
    """ix, vs and y of rows with ``grams``, whose places in ``names`` are looked up in tasks: no row is made dense."""
    bound_batches(rows.sparkSession)  # a row has thousands of n-grams, so ten thousand rows would be gigabytes
    shared = rows.sparkSession.sparkContext.broadcast({g: i for i, g in enumerate(names)})

    def looked_up(batches):
        number = shared.value
        for frame in batches:
            ix = [[number[g] for g in own] for own in frame["grams"]]
            yield pd.DataFrame({"ix": ix, "vs": [[1.0] * len(x) for x in ix], "y": frame["y"]})

    return rows.select("grams", "y").mapInPandas(looked_up, "ix array<int>, vs array<double>, y double")


def svr(rows: DataFrame, n: int, c: float = 1.0, epsilon: float = 0.0, rounds: int = 30, size: int = 0) -> tuple[np.ndarray, float]:
    """Linear SVR with the epsilon-insensitive loss by subgradient steps; each is one aggregation of sparse rows."""
    bound_batches(rows.sparkSession)
    w, b = np.zeros(size), 0.0
    for t in range(1, rounds + 1):
        sc = rows.sparkSession.sparkContext.broadcast((w, b))

        def gradient(batches, sc=sc):
            own, offset = sc.value
            gw, gb = np.zeros(len(own)), 0.0
            for frame in batches:  # the batch as one sparse matrix: columns one after another, with the row of each
                sizes = frame["ix"].map(len).to_numpy()
                if not len(sizes):
                    continue
                ix, vs = (np.concatenate([np.zeros(0, t), *frame[c]]).astype(t) for c, t in (("ix", np.int64), ("vs", np.float64)))
                row = np.repeat(np.arange(len(sizes)), sizes)
                e = np.bincount(row, own[ix] * vs, minlength=len(sizes)) + offset - frame["y"].to_numpy()
                side = np.where(np.abs(e) > epsilon, np.sign(e), 0.0)
                gw += np.bincount(ix, side[row] * vs, minlength=len(own))
                gb += side.sum()
            used = np.flatnonzero(gw)
            yield pd.DataFrame({"i": [*used.tolist(), -1], "g": [*gw[used].tolist(), gb]})

        sums = rows.mapInPandas(gradient, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # as many as features
        rate = 1.0 / (n * np.sqrt(t))
        w = w * (1 - rate)
        for r in sums:
            if r["i"] < 0:
                b -= rate * c * r["g"]
            else:
                w[r["i"]] -= rate * c * r["g"]
    return w, b


def extremes(names: list[str], weights) -> tuple[tuple[str, float], tuple[str, float]]:
    """The features of the largest and of the smallest weight; ties to the first name."""
    pairs = sorted(zip(names, map(float, weights), strict=False))
    return max(pairs, key=lambda x: x[1]), min(pairs, key=lambda x: x[1])


def report(kind: str, scored: DataFrame, names: list[str], weights, seconds: dict[str, float] | None = None) -> DataFrame:
    """One row: the baseline's name, its regression measures, the features of the largest and smallest weight, and how long
    its steps took, where that is given."""
    (top, high), (bottom, low) = extremes(names, weights)
    out = evaluate.regression(scored).select("mse", "rmse", "mae", "r2", "pearson")
    out = out.withColumns({"kind": F.lit(kind), "top_feature": F.lit(top), "top_weight": F.lit(high), "bottom_feature": F.lit(bottom), "bottom_weight": F.lit(low)})
    return out.withColumns({f"{k}_seconds": F.lit(float(v)) for k, v in seconds.items()}) if seconds else out


def residual_sums(fitted, rows: DataFrame) -> DataFrame:
    """ngram, support and residual: of each feature the rows that have it and the sum of their residuals, and of all rows under the
    intercept's name."""
    scored = fitted.transform(rows).select("grams", (F.col("y") - F.col("prediction")).alias("e"))
    names = F.array_append("grams", F.lit(INTERCEPT))
    return scored.select(F.explode(names).alias("ngram"), "e").groupBy("ngram").agg(F.count("*").alias("support"), F.sum("e").alias("residual"))


def optimality(kind: str, fitted, rows: DataFrame, names: list[str], n: int) -> DataFrame:
    """ngram, support, weight and gap: how far each feature is from the condition that holds at the optimum alone, for a row. The
    sum of its rows' residuals is zero (least squares), the penalty's gradient (ridge), or within the l1 part where its weight is 0
    (elastic net)."""
    l1, l2 = {"ols": (0.0, 0.0), "ridge": (0.0, 1.0), "enet": (0.5 * n, 0.5 * n)}[kind]
    weights = rows.sparkSession.createDataFrame([*zip(names, map(float, fitted.coefficients), strict=True), (INTERCEPT, 0.0)], "ngram string, weight double")
    w, r = F.col("weight"), F.col("residual")
    l1s, l2s = (F.when(F.col("ngram") == INTERCEPT, 0.0).otherwise(F.lit(x)) for x in (l1, l2))
    gap = F.when(w == 0, F.greatest(F.lit(0.0), F.abs(r) - l1s)).otherwise(F.abs(r - l2s * w - l1s * F.signum(w)))
    return residual_sums(fitted, rows).join(weights, "ngram").select("ngram", "support", "weight", (gap / n).alias("gap"))
