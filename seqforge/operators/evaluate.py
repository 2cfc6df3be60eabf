"""Evaluation of scores: regression, classification, ROC areas, thresholds, loss curves, folds.

Running sums over scores are made in two levels: distinct scores are aggregated first, and :func:`running` sums up inside
range partitions before it adds what lies in the ones before, so no window gathers all scores in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqforge.session import materialise


def regression(scored: DataFrame) -> DataFrame:
    """MSE, RMSE, MAE, RSE with its root and 1 - RSE, relative absolute error, and Pearson's correlation; one row."""
    mean = scored.agg(F.avg("y").alias("__mean"))
    e = F.col("score") - F.col("y")
    off = F.col("y") - F.col("__mean")
    out = scored.select("y", "score").crossJoin(F.broadcast(mean)).agg(  # one row
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("ss_res"), F.sum(off * off).alias("ss_tot"), F.sum(F.abs(e)).alias("abs_res"), F.sum(F.abs(off)).alias("abs_tot"), F.try_divide(F.covar_pop("score", "y"), F.stddev_pop("score") * F.stddev_pop("y")).alias("pearson")
    )
    rse = F.when(F.col("ss_tot") != 0, F.col("ss_res") / F.col("ss_tot"))
    return out.select("mse", F.sqrt("mse").alias("rmse"), "mae", rse.alias("rse"), F.sqrt(rse).alias("root_rse"), (1 - rse).alias("r2"), F.when(F.col("abs_tot") != 0, F.col("abs_res") / F.col("abs_tot")).alias("rae"), "pearson")


def counts(scored: DataFrame) -> DataFrame:
    pos, yes = F.col("y") > 0, F.col("score") > 0
    return scored.agg(F.count_if(pos & yes).alias("tp"), F.count_if(~pos & yes).alias("fp"), F.count_if(pos & ~yes).alias("fn"), F.count_if(~pos & ~yes).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def classification(found: DataFrame) -> DataFrame:
    """Measures from tp, fp, fn and tn; 0 where a denominator is 0, and the balanced error null there."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    balanced = F.when((tp + fn != 0) & (tn + fp != 0), (fn / (tp + fn) + fp / (tn + fp)) / 2)
    out = found.withColumns({"precision": precision, "recall": recall, "specificity": specificity, "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "error": _ratio(fp + fn, tp + fp + fn + tn), "balanced_error": balanced})
    return out.withColumns({"f1": _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "fss": _ratio(2 * F.col("specificity") * F.col("recall"), F.col("specificity") + F.col("recall"))})


def running(rows: DataFrame, key: str, values: list[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """``rows`` (distinct keys) with ``before_<value>`` for each value: its sum over the rows before, in the order of the key,
    and ``previous``: the key of the row before."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    bounds = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    part = F.lit(0)
    for b in bounds:
        part = part + F.when(F.col(key) > b, 1).otherwise(0)
    dealt = rows.withColumn("__part", -part if descending else part)
    end = F.min if descending else F.max
    totals = dealt.groupBy("__part").agg(end(key).alias("__end"), *[F.sum(v).alias(f"__t_{v}") for v in values])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows at most
    starts = totals.select("__part", end("__end").over(earlier).alias("__last"), *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__s_{v}") for v in values])
    placed = Window.partitionBy("__part").orderBy(order)
    inside = placed.rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"__i_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    out = dealt.withColumns({**sums, "__lag": F.lag(key).over(placed)}).join(F.broadcast(starts), "__part")
    out = out.withColumns({**{f"before_{v}": F.col(f"__s_{v}") + F.col(f"__i_{v}") for v in values}, "previous": F.coalesce("__lag", "__last")})
    return out.drop("__part", "__lag", "__last", *[f"__{x}_{v}" for v in values for x in "si"])


def by_score(scored: DataFrame) -> DataFrame:
    """Positive and negative labels of each distinct score."""
    pos = F.col("y").cast("int") > 0
    return materialise(scored.groupBy("score").agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")), "scores")


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve in percent, scores that tie as one trapezoid; 0 if a class is empty."""
    groups = running(by_score(scored), "score", ["p", "n"], descending=True)
    total = groups.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.col("n") * (2 * F.col("before_p") + F.col("p")) / 2.0).alias("area"))
    return total.select(F.when((F.col("P") > 0) & (F.col("N") > 0), 100.0 * F.col("area") / (F.col("P") * F.col("N"))).otherwise(0.0).alias("auc"))


def auc50(scored: DataFrame, most: int = 50) -> DataFrame:
    """Area up to ``most`` negatives over ``most`` times all positives, in percent. Groups of one score that begin before
    that many negatives close the trapezoid before; the last one reaches to all positives."""
    groups = running(by_score(scored), "score", ["p", "n"], descending=True)
    starts = groups.where(F.col("before_n") < most)
    # trapezoids between the starts of neighbouring groups, each group giving its own: from its start to its end
    ends_open = F.col("before_n") + F.col("n") < most
    closed = F.when(ends_open, F.col("n") * (2 * F.col("before_p") + F.col("p")) / 2.0).otherwise(0.0)
    totals = groups.agg(F.sum("p").alias("P"), F.sum("n").alias("N"))
    last = starts.agg(F.sum(closed).alias("area"), F.max_by("before_n", "before_n").alias("x"), F.max(F.struct("before_n", "before_p", "n", "p")).alias("last"))
    x0, y0 = F.col("last.before_n"), F.col("last.before_p")
    x1 = F.least(F.col("N"), F.lit(most))
    own = F.when(F.col("last.before_n") + F.col("last.n") < most, F.col("last.n") * (2 * y0 + F.col("last.p")) / 2.0).otherwise(0.0)
    area = F.col("area") - own + (x1 - x0) * (F.col("P") + y0) / 2.0
    return last.crossJoin(totals).select(F.when((F.col("P") > 0) & (F.col("N") > 0), 100.0 * area / (most * F.col("P"))).otherwise(0.0).alias("auc50"))


def tune(scored: DataFrame) -> DataFrame:
    """The threshold with the fewest errors (score > threshold is positive) among the midpoints of neighbouring distinct scores,
    below all (-inf) and above all (max + 1); ties to the lowest. One row: threshold and errors."""
    groups = running(by_score(scored), "score", ["p", "n"])
    total = groups.agg(F.sum("n").alias("N"), F.max("score").alias("top"), F.sum("p").alias("P"))
    cuts = groups.select("score", "before_p", "before_n", F.col("previous").alias("below")).crossJoin(F.broadcast(total))  # one row
    threshold = F.when(F.col("below").isNull(), F.lit(float("-inf"))).otherwise((F.col("below") + F.col("score")) / 2)
    errors = F.col("before_p") + F.col("N") - F.col("before_n")
    above = total.select((F.col("top") + 1).alias("threshold"), F.col("P").alias("errors"))
    every = cuts.select(threshold.alias("threshold"), errors.alias("errors")).unionByName(above)
    best = every.agg(F.min(F.struct("errors", "threshold")).alias("b"))
    return best.select("b.threshold", "b.errors")


def loss_curve(log: DataFrame) -> DataFrame:
    """A log (class, iteration, loss) with the loss over the class's largest, and the change from the iteration before."""
    w = Window.partitionBy("class")
    return log.withColumns({"relative": F.col("loss") / F.max("loss").over(w), "change": F.lag("loss").over(w.orderBy("iteration")) - F.col("loss")})


def rank_hash(*columns: str) -> Column:
    """A hash that other engines share: MD5 of the texts of the columns."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def stratified_folds(docs: DataFrame, key: str, label: str, folds: int = 4, validation: int = 10) -> DataFrame:
    """``docs`` with fold, and for each fold the split of the rest: every ``validation``-th of a class is validation, in the
    order of a hash. Deterministic. Classes may be large: the place in the class comes from a sort dealt by hash ranges."""
    placed = _place(docs, key, label)
    return placed.withColumns({"fold": (F.col("place") % folds).cast("int"), "held": (F.floor(F.col("place") / folds) % validation == 0)}).drop("place")


def _place(docs: DataFrame, key: str, label: str) -> DataFrame:
    """The place of each row in its class by the hash: counts of 4096 hash ranges first, then the place in the range."""
    h = rank_hash(key)
    dealt = docs.withColumns({"__h": h, "__r": F.substring(h, 1, 3)})
    ranges = dealt.groupBy(label, "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(label).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a class
    starts = ranges.select(F.col(label).alias("__l"), F.col("__r").alias("__r2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy(label, "__r").orderBy("__h", key)
    out = dealt.withColumn("__i", F.row_number().over(inside) - 1).join(starts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__r") == F.col("__r2")))
    return out.withColumn("place", F.col("__s") + F.col("__i")).drop("__h", "__r", "__r2", "__l", "__s", "__i")


def splits(folds: DataFrame, k: int) -> DataFrame:
    """Of one fold: test rows, and train and validation rows of the others, as ``split``."""
    split = F.when(F.col("fold") == k, "test").when(F.col("held"), "validation").otherwise("train")
    return folds.withColumn("split", split)


def zip_rows(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of both side by side, by their places in the order of a column that each has."""
    a, b = (_numbered(x, order) for x in (left, right))
    return a.join(b.withColumnsRenamed({c: f"right_{c}" for c in b.columns if c != "place"}), "place")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    return running(rows.withColumn("__one", F.lit(1)), order, ["__one"]).withColumn("place", F.col("before___one") + 1).drop("__one", "before___one", "previous")
