"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join; DataFrame operations only.

A listed entry is a host and a path prefix, canonical if the host is in lower case and the path begins with a slash;
entries are brought to this form. The filter (:mod:`seqforge.llm.bloom`) holds the listed hosts and the listed entries, and
grows with the list. A url's host gives as possible hosts only those parent domains that have as many labels as some listed
host, so a host of many labels makes few. Those that the filter may hold go on: each is put before the prefixes of the
path that have the length of a listed one with as many labels, and is looked up again. What passes is joined with the
list by equality, which removes false positives, and the longest entry wins (ties: the longer host, then block).

Defined results: host and path of a null url, or one without ``://``, are empty, its rule is null and its verdict the
default; pages that repeat get a row each; an empty list gives the default everywhere; listed entries that are null take no
part; very long urls are judged whole; an empty table gives no rows; extra columns pass through, and columns of the added
names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.llm import bloom
from seqforge.session import materialise

#: The rules of the report.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    parts = r"(?s)^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, parts, 1), _UPPER, _LOWER), F.regexp_extract(rest, parts, 2)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """verdict, rule, host and path of literal rules (verdict, rule)."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])
    listed = spark.range(1).select(F.inline(rows))
    at = F.instr("rule", "/")
    return listed.select("verdict", "rule", F.substring("rule", F.lit(1), at - 1).alias("host"), F.substring("rule", at, F.length("rule")).alias("path"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: verdict, rule, host and path, any number."""
    low = F.translate("host", _UPPER, _LOWER)
    listed = rules.where("host is not null and path is not null").select(low.alias("h"), F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit("/"), "path")).alias("p"), "rule", "verdict")
    listed = materialise(listed.select(F.concat("h", "p").alias("key"), "h", "rule", "verdict", F.length("h").alias("n_host"), F.length("p").alias("n_path"), F.size(F.split("h", r"\.")).alias("labels")), "listed")
    # distinct numbers of labels, and the path lengths of each: no more than a host has labels and a url characters
    sizes = listed.groupBy("labels").agg(F.sort_array(F.collect_set("n_path")).alias("lengths")).orderBy("labels").collect()
    filter_ = bloom.build(listed.select("key").unionByName(listed.select(F.col("h").alias("key"))))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(url_col).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    h, p = host_and_path(F.col("__url"))
    urls = urls.select("__url", h.alias("h"), p.alias("p"))
    n = F.length("h") - F.length(F.replace("h", F.lit("."), F.lit(""))) + 1
    kind = "array<struct<labels:int,domain:string,lengths:array<int>>>"
    domains = F.array(*[F.struct(F.lit(r["labels"]).alias("labels"), F.substring_index("h", ".", -r["labels"]).alias("domain"), F.array(*[F.lit(x) for x in r["lengths"]]).cast("array<int>").alias("lengths")) for r in sizes]).cast(kind)
    domains = urls.select("__url", "p", F.explode(F.filter(domains, lambda d: d["labels"] <= n)).alias("d")).select("__url", "p", "d.domain", "d.lengths")
    domains = filter_.flag(domains, F.col("domain")).where("__maybe").drop("__maybe")
    prefixes = F.transform(F.filter("lengths", lambda k: k <= F.length("p")), lambda k: F.substring("p", F.lit(1), k))
    keys = domains.select("__url", "domain", F.explode(prefixes).alias("q")).select("__url", F.concat("domain", "q").alias("key"))
    possible = filter_.flag(keys, F.col("key")).where("__maybe").drop("__maybe")
    order = F.struct(F.col("n_host") + F.col("n_path"), F.col("n_host"), F.col("verdict"))
    best = possible.join(listed.drop("h", "labels"), "key").groupBy("__url").agg(F.max_by(F.struct("rule", "verdict"), order).alias("__best"))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    out = out.join(best, F.col(url_col) == F.col("__url"), "left").drop("__url")
    return out.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))}).drop("__best")


def report(pages: DataFrame) -> DataFrame:
    out = judge(pages.select("page_id", "url"), rules_frame(pages.sparkSession, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
with u as (select row_number() over () r, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
hp as (select r, page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)([^?#]*)', 2) path from u),
rules(verdict, rule, rhost, rpath) as (values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
best as (select r, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict from hp join rules
  on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by r)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from hp left join best using (r)
"""
