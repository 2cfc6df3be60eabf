"""Queries of the kept search tree: many models in one run, orders of traversal, long gaps, byte symbols, large models, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqforge.functions import text as T
from seqforge.operators import evaluate, learn, model, multiclass, search, sweep
from seqforge.operators.frontier import Frontier
from seqforge.operators.learn import LearnConfig
from seqforge.plans import fixtures as X
from seqforge.plans.catalogue import _STEPS, MAXPAT, MINSUP, WORDS, R, _oracles, _register, grams_sql, learn_blocks, learned, q

# --- many models in one run ------------------------------------------------------------------------------------------

_GROUP_DOCS = """e as materialized (select d.doc_id, regexp_replace(lower(d.text), '[^a-z]', '', 'g') seq, cast(2 * l.quality - 1 as double) y, d.lang || '/' || d.source grp
  from documents d join labels l on d.doc_id = l.doc_id where length(regexp_replace(lower(d.text), '[^a-z]', '', 'g')) > 0)"""


def grouped_docs(spark, d) -> DataFrame:
    """char_docs with grp: language and source."""
    own = X.table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source").alias("grp"))
    return X.char_docs(spark, d).join(own, "doc_id")


def _group_sql(k: int, maxpat: int) -> str:
    blocks = [f"with {_GROUP_DOCS}, p as materialized ({grams_sql(range(1, maxpat + 1))}), mu as (select grp, avg(y) m from e group by grp), f0 as (select doc_id, grp, y - m y, cast(0 as double) f from e join mu using (grp)), b0 as (select grp from mu)"]
    for i in range(1, k + 1):
        # a group goes on as long as it has an n-gram with a gradient
        blocks.append(f"""i{i} as materialized (select grp, avg(y - f) d from f{i - 1} where grp in (select grp from b{i - 1}) group by grp), r{i} as materialized (select doc_id, grp, y, f + d f from f{i - 1} join i{i} using (grp)),
c{i} as (select grp, ng, sz, avg(y - f) step, round(abs(sum(2 * (y - f))), 9) g from p join r{i} using (doc_id) group by grp, ng, sz),
b{i} as materialized (select grp, ng, step from (select *, row_number() over (partition by grp order by g desc, sz, ng) n from c{i} where g > 0) where n = 1),
f{i} as materialized (select r.doc_id, r.grp, r.y, r.f + case when p.ng is not null then b.step else 0 end f from r{i} r join b{i} b on b.grp = r.grp left join p on p.doc_id = r.doc_id and p.ng = b.ng)""")
    rows = " union all ".join(f"select grp, cast({i} as int) itr, '{model.INTERCEPT}' ngram, {q('d')} step from i{i} union all select grp, {i}, ng, {q('step')} from b{i}" for i in range(1, k + 1))
    return ", ".join(blocks) + " " + rows


@_register("grouped_models", _group_sql(2, 3))
def grouped_models(spark, d):
    """Two learning steps of a model for each language and source, all in the jobs of one run."""
    models = sweep.learn_groups(grouped_docs(spark, d), LearnConfig(maxpat=3, max_iterations=2, convergence=-1.0))
    rows = []
    for grp, out in models.items():
        itr = 0
        for step, gram in out.model.steps:
            itr += gram == model.INTERCEPT
            rows.append((grp, itr, gram, step))
    return spark.createDataFrame(rows, "grp string, itr int, ngram string, step double").withColumn("step", F.round("step", 6) + 0.0)


_CLASSES = (1, 2, 3, 4)


def _fold_sql() -> str:
    blocks = [f"with {X.LANG_DOCS}, p as materialized ({grams_sql((1,))}), fo as materialized (select doc_id, \"label\", cast((row_number() over (partition by \"label\" order by md5(cast(doc_id as varchar)), doc_id) - 1) % 4 as int) fold from e)"]
    scores = []
    for k in range(4):
        for c in _CLASSES:
            n = f"_{k}_{c}"
            blocks.append(f"z{n} as (select doc_id, case when \"label\" = {c} then 1.0::double else -1.0::double end y, cast(0 as double) f from fo where fold <> {k})")
            blocks += learn_blocks(2, f"z{n}", n)
            blocks.append(f"w{n} as (select ng, sum(step) w from (select ng, step from b1{n} union all select ng, step from b2{n}) group by ng)")
            scores.append(f"select fo.doc_id, \"label\", fold, {c} k, (select d from i1{n}) + (select d from i2{n}) + coalesce(sum(w), 0) s from fo left join p using (doc_id) left join w{n} using (ng) where fold = {k} group by all")
    return ", ".join(blocks) + f", s as ({' union all '.join(scores)}), pr as (select doc_id, \"label\", fold, cast(arg_max(k, round(s, 9) * 1000000 - k) as int) predicted from s group by all) select doc_id, \"label\", fold, predicted from pr"


@_register("fold_models", _fold_sql())
def fold_models(spark, d):
    """Four folds, each predicted by one-vs-rest models of the others."""
    folds = evaluate.stratified_folds(X.lang_docs(spark, d), "doc_id", "label").drop("held")
    return multiclass.fold_predictions(folds, list(_CLASSES), LearnConfig(maxpat=1, max_iterations=2, convergence=-1.0), 4).select("doc_id", "label", "fold", "predicted")


# --- the search ------------------------------------------------------------------------------------------------------


def kept_best(docs: DataFrame, config: search.SearchConfig) -> dict:
    """The winner of a single search as a row; squared error starts from the mean."""
    tree = Frontier.of(docs, config, ["y"], once=True)
    tree.shift(0, {"": tree.documents().agg(F.avg(F.nanvl("y0", F.lit(None)))).first()[0] or 0.0})
    found = tree.search([("", 0)])["", 0]
    tree.close()
    return {} if found is None else {"ngram": found.ngram, "size": found.size, "gradient": round(found.gradient, 6) + 0.0, "support": found.support}


def _winners(spark, rows: list[tuple[str, dict]], shown=lambda g: g.replace(T.WILD, "*")) -> DataFrame:
    return spark.createDataFrame([(name, shown(r["ngram"]), r["size"], r["gradient"], r["support"]) for name, r in rows if r], "name string, ngram string, size int, gradient double, support long")


_ORDERS = ("bfs", "dfs", "best")


@_register("traversals", f"select unnest(['bfs', 'dfs', 'best']) \"name\", * from ({_oracles['best_ngram_squared']})")
def traversals(spark, d):
    """The winner of each order of traversal."""
    docs = X.char_docs(spark, d)
    return _winners(spark, [(t, kept_best(docs, search.SearchConfig(maxpat=MAXPAT, minsup=MINSUP, traversal=t))) for t in _ORDERS])


_LONG = {"words": True, "maxpat": 10, "gaps": (0, 5), "minsup": 100}


@_register("long_gap_pattern", f"""with recursive {X.EVENT_SEQS}, {WORDS}, g as (select doc_id, 2 * (y - (select avg(y) from e)) g from e), k as (select unnest(range(6))::int k),
x(doc_id, ix, ng, sz) as (select doc_id, i, ws[i], 1 from (select doc_id, ws, unnest(generate_series(1, len(ws)))::int i from w)
  union all select x.doc_id, x.ix + 1 + k, x.ng || repeat(' ' || chr(57344), k) || ' ' || ws[x.ix + 1 + k], x.sz + 1 + k from x join w on w.doc_id = x.doc_id, k where x.ix + 1 + k <= len(ws) and x.sz + 1 + k <= 10)
select 'best' "name", replace(ng, chr(57344), '*') ngram, cast(sz as int) size, {q('-sum(g)')} gradient, count(*) support from (select distinct doc_id, ng, sz from x) join g using (doc_id) group by ng, sz having count(*) >= {_LONG['minsup']} order by round(abs(sum(g)), 9) desc, sz, ng limit 1""")
def long_gap_pattern(spark, d):
    """Patterns of up to ten tokens with runs of up to five wildcards, grown from places; no mask is enumerated."""
    row = kept_best(X.event_seqs(spark, d), search.SearchConfig(**_LONG))
    return _winners(spark, [("best", row)])


_BYTES = "b as materialized (select d.doc_id, hex(regexp_replace(d.text, '\\s', '', 'g')) h, cast(2 * l.quality - 1 as double) y from documents d join labels l on d.doc_id = l.doc_id where length(regexp_replace(d.text, '\\s', '', 'g')) > 0)"


def byte_docs(spark, d) -> DataFrame:
    """doc_id, seq (the whole text) and y of labelled documents that are not blank."""
    docs = X.table(spark, d, "documents").join(X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return docs.select("doc_id", F.col("text").alias("seq"), (2.0 * F.col("quality") - 1.0).alias("y")).where(F.length(F.regexp_replace("seq", r"\s", "")) > 0)


@_register("best_ngram_bytes", f"""with {_BYTES}, g as (select doc_id, 2 * (y - (select avg(y) from b)) g from b),
p as ({' union all '.join(f'select distinct doc_id, {n} sz, substr(h, 2 * i - 1, {2 * n}) ng from (select doc_id, h, unnest(generate_series(1, length(h) // 2 - {n - 1})) i from b where length(h) >= {2 * n})' for n in (1, 2, 3))})
select 'best' "name", ng ngram, sz size, {q('-sum(g)')} gradient, count(*) support from p join g using (doc_id) group by ng, sz having count(*) >= {MINSUP} order by round(abs(sum(g)), 9) desc, sz, ng limit 1""")
def best_ngram_bytes(spark, d):
    """The best n-gram of bytes, shown as hex digits."""
    row = kept_best(byte_docs(spark, d), search.SearchConfig(maxpat=3, minsup=MINSUP, bytes=True))
    return _winners(spark, [("best", row)], lambda g: g.encode("latin-1").hex().upper())


#: Literal rules of bytes: an accented letter, half of one, and others.
_BYTE_RULES = [("C3A9", 0.5), ("C3", 0.25), ("A9", -0.125), ("6E74", 1.0), ("BCC3", -2.0)]


@_register("score_docs_bytes", f"""with {_BYTES}, m(ngram, weight) as (values {X.values(_BYTE_RULES)}), o as (select distinct doc_id, substr(h, 2 * i - 1, k.n) ng from (select doc_id, h, unnest(generate_series(1, length(h) // 2)) i from b) cross join (values (2), (4)) k(n) where 2 * i - 2 + k.n <= length(h))
select b.doc_id, {q('coalesce(sum(weight), 0)')} score, count(weight) n_rules from b left join (select doc_id, weight from o join m on ng = ngram) x on x.doc_id = b.doc_id group by b.doc_id""")
def score_docs_bytes(spark, d):
    rules = [(bytes.fromhex(g).decode("latin-1"), w) for g, w in _BYTE_RULES]
    return model.score(byte_docs(spark, d), rules, 0.0, as_bytes=True).select("doc_id", R("score", "score"), "n_rules")


def _counter_sql(maxpat: int) -> str:
    agg = "-sum(g) gr, -sum(case when g > 0 then g else 0 end) up, -sum(case when g > 0 then 0 else g end) un, count(*) sup"
    blocks = [f"with {X.CHAR_DOCS}, g as (select doc_id, 2 * (y - (select avg(y) from e)) g from e), p as materialized ({grams_sql(range(1, maxpat + 1))}), t0 as (select 0.0::double t)"]
    for n in range(1, maxpat + 1):
        alive = f"and substr(ng, 1, {n - 1}) in (select ng from s{n - 1})" if n > 1 else ""
        blocks.append(f"l{n} as materialized (select ng, {agg} from p join g using (doc_id) where sz = {n} {alive} group by ng)")
        blocks.append(f"t{n} as materialized (select greatest((select t from t{n - 1}), coalesce(max(round(abs(gr), 9)) filter (sup >= {MINSUP}), 0)) t from l{n})")
        blocks.append(f"s{n} as materialized (select ng from l{n} where sup >= {MINSUP} and round(greatest(abs(up), abs(un)), 9) > (select t from t{n}))")
    return ", ".join(blocks) + " " + " union all ".join(f"select cast({n} as int) size, (select count(*) from l{n}) candidates, (select count(*) from s{n}) survivors, cast(0 as bigint) rewritten" for n in range(1, maxpat + 1))


@_register("search_counters", _counter_sql(3))
def search_counters(spark, d):
    """Candidates, survivors and corrected bounds of each level of a search."""
    state = learn.prepare(X.char_docs(spark, d), False)
    f = F.lit(learn.intercept_step(state, "squared"))
    found = search.best_ngram(state.withColumn("g", 2 * (F.col("y") - f)), search.SearchConfig(maxpat=3, minsup=MINSUP))
    done = {c[0]: c for c in found.counters}
    return spark.createDataFrame([done.get(n, (n, 0, 0, 0)) for n in (1, 2, 3)], "size int, candidates long, survivors long, rewritten long")


# --- large and tuned models ------------------------------------------------------------------------------------------

#: Sizes of the benchmark's n-grams, which are the rules of a large model.
_SIZES = range(3, 11)
_MANY = f"""m as materialized (select distinct ng ngram, sz / 8.0::double weight from ({grams_sql(_SIZES, "(select item_id doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') seq from benchmark)")}))"""


@_register("score_many_rules", f"with {X.CHAR_DOCS}, {_MANY}, p as ({grams_sql(_SIZES)}), h as (select doc_id, weight from p join m on ng = ngram) select e.doc_id, {q('coalesce(sum(weight), 0)')} score, count(weight) n_rules from e left join h on h.doc_id = e.doc_id group by e.doc_id")
def score_many_rules(spark, d):
    """Tens of thousands of rules: all n-grams of three to ten letters of the benchmark, weighted by their size."""
    seq = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    grams = F.array_distinct(F.flatten(F.array(*[T.mask_grams(F.array(), (False,) * n, False, seq) for n in _SIZES])))
    rules = X.table(spark, d, "benchmark").select(F.explode(grams).alias("ngram")).distinct().withColumn("weight", F.length("ngram") / 8.0)
    return model.score(X.char_docs(spark, d), rules, 0.0).select("doc_id", R("score", "score"), "n_rules")


@_register("tuned_model", f"""{_STEPS}, wt as (select ngram, sum(step) w from st where ngram <> '{model.INTERCEPT}' group by ngram), s as materialized (select e.doc_id, e.y, round((select sum(step) from st where ngram = '{model.INTERCEPT}') + coalesce(sum(w), 0), 9) score from e left join wt on contains(seq, ngram) group by e.doc_id, e.y),
gr as (select score, count(*) filter (y > 0) p, count(*) filter (y <= 0) n from s group by score),
cu as (select score, lag(score) over (order by score) lo, coalesce(sum(p) over (order by score rows between unbounded preceding and 1 preceding), 0) bp, sum(n) over (order by score rows between current row and unbounded following) an from gr),
th as (select case when lo is null then cast(-1.7976931348623157e308 as double) else (lo + score) / 2 end threshold, bp + an errors from cu union all select max(score) + 1, sum(p) from gr),
b as (select threshold, errors from th order by errors, threshold limit 1)
select cast(max(errors) as bigint) errors, count(*) filter (y > 0 and score > threshold) tp, count(*) filter (y <= 0 and score > threshold) fp, count(*) filter (y > 0 and score <= threshold) fn, count(*) filter (y <= 0 and score <= threshold) tn from s, b""")
def tuned_model(spark, d):
    """A learned model with the threshold that makes the fewest errors as its bias, and what it decides."""
    docs, m = X.char_docs(spark, d), learned(spark, d).model
    _, errors = m.tune(docs)
    return evaluate.counts(m.transform(docs)).select(F.lit(errors).cast("long").alias("errors"), "tp", "fp", "fn", "tn")


def _stopping_sql(maxpat: int, most: int) -> str:
    head = f"with {X.CHAR_DOCS}, tr as (select doc_id, seq, y from e where lang in ('en', 'de')), va as (select doc_id, seq, y from e where lang not in ('en', 'de')), p as materialized ({grams_sql(range(1, maxpat + 1), 'tr')}), f0 as (select doc_id, y, cast(0 as double) f from tr)"
    blocks = [head, *learn_blocks(6)]
    for k in (1, 6):
        steps = " union all ".join(f"select ng, step from b{i}" for i in range(1, k + 1))
        deltas = " + ".join(f"(select d from i{i})" for i in range(1, k + 1))
        blocks.append(f"w{k} as (select ng, sum(step) w from ({steps}) group by ng), v{k} as (select sum((y - s) * (y - s)) loss from (select va.doc_id, va.y, {deltas} + coalesce(sum(w), 0) s from va left join w{k} on contains(seq, ng) group by va.doc_id, va.y))")
    return ", ".join(blocks) + f" select case when (select loss from v6) > (select loss from v1) then 6 else {most} end::int steps, case when (select loss from v6) > (select loss from v1) then 'validation loss' else 'iterations' end reason"


@_register("early_stopping", _stopping_sql(2, 7))
def early_stopping(spark, d):
    """Learning on two languages, with the documents of the others for validation: after how many steps it ends, and why."""
    docs, known = X.char_docs(spark, d), F.col("lang").isin("en", "de")
    out = learn.learn(docs.where(known), LearnConfig(maxpat=2, max_iterations=7, convergence=-1.0), validation=docs.where(~known))
    return spark.createDataFrame([(len(out.log), out.reason)], "steps int, reason string")
