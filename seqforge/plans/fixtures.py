"""The query inputs, as DataFrames and as DuckDB common table expressions, and the literal models of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer parts than there are cores (a small file of one row group is read by one task) is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def char_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (the letters a-z of the whole text), y (1 or -1 by quality) and lang, of labelled documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seq = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    out = docs.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", seq.alias("seq"), (2.0 * F.col("quality") - 1.0).alias("y"), "lang")
    return out.where(F.length("seq") > 0)


CHAR_DOCS = """e as materialized (select d.doc_id, regexp_replace(lower(d.text), '[^a-z]', '', 'g') seq, cast(2 * l.quality - 1 as double) y, d.lang
  from documents d join labels l on d.doc_id = l.doc_id where length(regexp_replace(lower(d.text), '[^a-z]', '', 'g')) > 0)"""


def event_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (a user), seq (all event types in the order of time, as words) and y (an exact integer sum)."""
    events = table(spark, sf_dir, "events")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    y = F.sum(F.floor("value").cast("long")).cast("double")
    return events.groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(ordered, " ").alias("seq"), y.alias("y"))


EVENT_SEQS = """e as materialized (select user_id doc_id, string_agg(event_type, ' ' order by ts, event_id) seq, cast(sum(cast(floor(value) as bigint)) as double) y
  from events group by user_id)"""


def lang_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (whole text, letters a-z) and label: the language's place in the alphabet."""
    docs = table(spark, sf_dir, "documents")
    seq = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    label = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")).cast("int")
    return docs.select("doc_id", seq.alias("seq"), label.alias("label")).where((F.length("seq") > 0) & (F.col("label") > 0))


LANGS = ["de", "en", "es", "fr"]
LANG_DOCS = """e as materialized (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') seq, cast(list_position(['de', 'en', 'es', 'fr'], lang) as int) "label"
  from documents where lang in ('de', 'en', 'es', 'fr') and length(regexp_replace(lower(text), '[^a-z]', '', 'g')) > 0)"""

#: Literal models: dyadic weights, whose sums are exact in any order.
RULES = [("nt", -0.25), ("e", 0.5), ("th", 0.125), ("qu", -0.5), ("ung", 0.375), ("zzzzz", 2.0)]
WILD_RULES = [("a*d", 0.5), ("t*e", -0.25), ("on", 0.125), ("s*i", 1.0)]
OFFSET = -0.5
EVENT_RULES = [("click", 0.25), ("view click", -0.5), ("signup * view", 1.0), ("purchase purchase", 0.125)]


def values(rows: list[tuple]) -> str:
    """SQL rows; texts quoted, numbers as doubles where they have a fraction."""
    one = lambda v: f"'{v}'" if isinstance(v, str) else f"cast({v!r} as double)" if isinstance(v, float) else str(v)
    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """char_docs with the score of the literal model."""
    from seqforge.operators.model import score

    return score(char_docs(spark, sf_dir), rules_frame(spark, RULES), OFFSET)


def rules_frame(spark: SparkSession, rules: list[tuple[str, float]]) -> DataFrame:
    """The rules as rows of the JVM: no Python worker is started for them."""
    from seqforge.functions.text import WILD

    rows = [F.struct(F.lit(g.replace("*", WILD)).alias("ngram"), F.lit(float(w)).alias("weight")) for g, w in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


SCORED = f"""{CHAR_DOCS},
m(ngram, weight) as (values {values(RULES)}),
hit as materialized (select doc_id, ngram, weight from e join m on contains(seq, ngram)),
s as materialized (select e.doc_id, e.y, cast({OFFSET} as double) + coalesce(sum(weight), 0) score, count(ngram) n_rules
  from e left join hit on e.doc_id = hit.doc_id group by e.doc_id, e.y)"""
