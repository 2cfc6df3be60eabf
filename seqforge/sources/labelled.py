"""Sources: labelled sequences, models, hex dumps and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqforge.functions.text import clean_hex_line, leading_number, split_label
from seqforge.session import materialise


def parse_lines(lines: DataFrame, value: str = "value", drop_empty: bool = True) -> DataFrame:
    """``lines`` with y and seq: blank lines and those that begin with ``;`` are left out, a carriage return at the end is
    dropped, the label is the number that the text before the first tab or space begins with."""
    line = F.regexp_replace(F.col(value), "\r$", "")
    kept = lines.where((F.col(value) != "") & ~F.startswith(F.col(value), F.lit(";")))
    label, seq = split_label(line)
    out = kept.select(*[c for c in lines.columns if c != value], leading_number(label).alias("y"), seq.alias("seq"), (~line.rlike("[\t ]")).alias("malformed"))
    return out.where(F.length("seq") > 0) if drop_empty else out


def read_labelled(spark: SparkSession, path: str, limit: int = -1, drop_empty: bool = True, positive: int | None = None) -> DataFrame:
    """Labelled sequences of a text file. ``limit``: the first accepted rows, by file and place; ``positive``: turns
    labels into 1 for this class and -1 for others."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    out = parse_lines(raw, drop_empty=drop_empty)
    if positive is not None:
        out = out.withColumn("y", one_vs_rest(F.col("y"), positive))
    if limit >= 0:
        out = out.orderBy("file", "place").limit(limit)
    return out.select("y", "seq", "malformed")


def one_vs_rest(y: Column, positive: int | Column) -> Column:
    return F.when(y.cast("int") == positive, 1.0).otherwise(-1.0)


def stats(docs: DataFrame) -> DataFrame:
    """Counts of positive, negative and all labels, and their mean."""
    return docs.agg(F.count_if(F.col("y") > 0).alias("n_pos"), F.count_if(F.col("y") <= 0).alias("n_neg"), F.count("*").alias("n"), F.avg("y").alias("mean_y"))


def centre(docs: DataFrame) -> tuple[DataFrame, float]:
    """``docs`` with the mean of y taken off, and that mean, a model's bias later."""
    mean = docs.agg(F.avg("y")).first()[0] or 0.0
    return docs.withColumn("y", F.col("y") - F.lit(mean)), mean


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row``: their places from 0 without gaps, in the order in which the files are read. Counts of the
    partitions come first, so no task sees all rows."""
    placed = materialise(rows.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    return placed.join(F.broadcast(starts), F.col("__p") == F.col("__q")).withColumn("row", F.col("__s") + F.col("__i")).drop("__p", "__q", "__i", "__s")


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """The rows ``step ngram`` of a model log, in order."""
    parts = F.split("value", " ", 2)
    return numbered(spark.read.text(path)).select(F.col("row").alias("itr"), leading_number(parts[0]).alias("step"), F.get(parts, F.lit(1)).alias("ngram"))


def read_hex_dumps(spark: SparkSession, folder: str, labels: DataFrame) -> DataFrame:
    """Id, class and the bytes of ``<id>.bytes`` files as one hex string; labels without a file are left out."""
    files = spark.read.text(f"{folder}/*.bytes", wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.bytes$", 1)
    files = files.select(name.alias("Id"), F.array_join(F.transform(F.split("value", "\r?\n"), clean_hex_line), "").alias("seq"))
    return labels.join(files, "Id")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="Id string, Class int")


def read_matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A CSV matrix of numbers in long form: row (from 0, by place), column (from 1), value."""
    schema = ", ".join(f"c{i} double" for i in range(1, columns + 1))
    wide = numbered(spark.read.csv(path, schema=schema))
    return wide.unpivot("row", [f"c{i}" for i in range(1, columns + 1)], "column", "value").withColumn("column", F.substring("column", 2, 9).cast("int"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A learner's iteration log, whose header is skipped."""
    return spark.read.csv(path, header=True, enforceSchema=True, schema=LOG_SCHEMA)


#: The columns of an iteration log.
LOG_SCHEMA = "Iteration int, `#Features` int, `#rewritten` bigint, `#pruned` bigint, total bigint, optimalStepLength double, symbol string, loss double, regLoss double, convRate double"
