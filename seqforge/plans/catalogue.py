"""The registered queries of the engine and their DuckDB equivalents. Every query reads its tables and texts whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions import loss as L
from seqforge.functions import text as T
from seqforge.operators import baselines, evaluate, frontier, generate, index, learn, model, multiclass, search
from seqforge.plans import fixtures as X
from seqforge.session import fresh_path, materialise
from seqforge.sources import labelled, sinks, stream
from seqforge.streaming import scoring

_queries: dict = {}
_oracles: dict[str, str] = {}
#: Largest n-gram of the searches.
MAXPAT = 4
MINSUP = 5


def _register(name: str, sql: str | None = None):
    def put(fn):
        _queries[name] = fn
        if sql is not None:
            _oracles[name] = sql
        return fn

    return put


def R(column, name: str):
    """Rounded for comparison between engines, without negative zeros."""
    return (F.round(column, 6) + 0.0).alias(name)


def q(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def grams_sql(sizes, frm: str = "e", keep: str = "") -> str:
    """Distinct n-grams of each document, in SQL."""
    one = "select distinct doc_id{k}, {n} sz, substr(seq, i, {n}) ng from (select doc_id{k}, seq, unnest(generate_series(1, length(seq) - {m})) i from {f} where length(seq) >= {n})"
    return " union all ".join(one.format(n=n, m=n - 1, f=frm, k=keep) for n in sizes)


def word_grams_sql(masks: list[tuple[bool, ...]]) -> str:
    """Distinct word patterns of each document; wildcards shown as *."""
    parts = []
    for mask in masks:
        n = len(mask)
        gram = " || ' ' || ".join("'*'" if w else f"ws[i + {k}]" for k, w in enumerate(mask))
        parts.append(f"select distinct doc_id, {n} sz, {gram} ng from (select doc_id, ws, unnest(generate_series(1, len(ws) - {n - 1})) i from w where len(ws) >= {n})")
    return " union all ".join(parts)


WORDS = "w as materialized (select doc_id, y, string_split(seq, ' ') ws from e)"


# --- sources and projections -----------------------------------------------------------------------------------------

_LINE_SQL = "case doc_id % 5 when 0 then '1.5abc' || chr(9) || seq when 1 then '-2e1 ' || seq || chr(13) when 2 then '; ' || seq when 3 then seq else '' end"


@_register("parse_labelled_lines", f"""with {X.CHAR_DOCS}, l as (select doc_id, regexp_replace({_LINE_SQL}, '\\r$', '') v from e),
k as (select doc_id, v, regexp_extract(v, '^([^ \\t]*)', 1) a, case when regexp_matches(v, '[ \\t]') then regexp_extract(v, '^[^ \\t]*[ \\t](.*)$', 1) else v end seq from l where v <> '' and not starts_with(v, ';'))
select doc_id, coalesce(try_cast(regexp_extract(a, '^([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) as double), 0) y, md5(seq) seq_md5, not regexp_matches(v, '[ \\t]') malformed from k where length(seq) > 0""")
def parse_labelled_lines(spark, d):
    docs = X.char_docs(spark, d)
    kind = F.col("doc_id") % 5
    line = F.when(kind == 0, F.concat(F.lit("1.5abc\t"), "seq")).when(kind == 1, F.concat(F.lit("-2e1 "), "seq", F.lit("\r"))).when(kind == 2, F.concat(F.lit("; "), "seq")).when(kind == 3, F.col("seq")).otherwise("")
    return labelled.parse_lines(docs.select("doc_id", line.alias("value"))).select("doc_id", "y", F.md5("seq").alias("seq_md5"), "malformed")


_KEPT = """l as (select doc_id, regexp_replace({line}, '\\r$', '') v from e),
k as (select doc_id, regexp_extract(v, '^([^ \\t]*)', 1) a, case when regexp_matches(v, '[ \\t]') then regexp_extract(v, '^[^ \\t]*[ \\t](.*)$', 1) else v end seq from l where v <> '' and not starts_with(v, ';')),
n as (select doc_id, coalesce(try_cast(regexp_extract(a, '^([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) as double), 0) y, seq from k)""".format(line=_LINE_SQL)


def _line_file(spark, d) -> str:
    """The lines of parse_labelled_lines as text files that follow one another in the order of doc_id; each task writes a range of it."""
    kind, path = F.col("doc_id") % 5, fresh_path(spark, "lines")
    line = F.when(kind == 0, F.concat(F.lit("1.5abc\t"), "seq")).when(kind == 1, F.concat(F.lit("-2e1 "), "seq", F.lit("\r"))).when(kind == 2, F.concat(F.lit("; "), "seq")).when(kind == 3, F.col("seq")).otherwise("")
    X.char_docs(spark, d).select("doc_id", line.alias("value")).orderBy("doc_id").select("value").write.option("lineSep", "\n").text(path)
    return path


@_register("labelled_file", f"with {X.CHAR_DOCS}, {_KEPT} select y, md5(seq) seq_md5, count(*) n from n where length(seq) > 0 group by all")
def labelled_file(spark, d):
    """A labelled file as the learner reads it."""
    return labelled.read_labelled(spark, _line_file(spark, d)).groupBy("y", F.md5("seq").alias("seq_md5")).agg(F.count("*").alias("n"))


@_register("labelled_file_limit", f"with {X.CHAR_DOCS}, {_KEPT} select y, md5(seq) seq_md5 from n where length(seq) > 0 order by doc_id limit 40")
def labelled_file_limit(spark, d):
    """The first 40 accepted rows of a file: the limit is the feature."""
    return labelled.read_labelled(spark, _line_file(spark, d), limit=40).select("y", F.md5("seq").alias("seq_md5"))


@_register("labelled_stream", _oracles["labelled_file"])
def labelled_stream(spark, d):
    """The same file followed as a stream, whose rows are appended to a table."""
    out = fresh_path(spark, "stream-rows")
    rows = stream.read_labelled_stream(spark, _line_file(spark, d)).select("y", F.md5("seq").alias("seq_md5"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("y", "seq_md5").agg(F.count("*").alias("n"))


@_register("test_scan", f"with {X.CHAR_DOCS}, {_KEPT} select case when trunc(y) = 1 then 1.0::double else -1.0::double end y, md5(seq) seq_md5, count(*) n from n group by all")
def test_scan(spark, d):
    """A file as the predictor reads it: empty sequences stay, labels against one class."""
    return labelled.read_labelled(spark, _line_file(spark, d), drop_empty=False, positive=1).groupBy("y", F.md5("seq").alias("seq_md5")).agg(F.count("*").alias("n"))


@_register("label_table", 'select cast(doc_id as varchar) "Id", quality "Class" from labels')
def label_table(spark, d):
    path = fresh_path(spark, "labels")
    X.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("Id"), F.col("quality").alias("Class")).write.csv(path, header=True)
    return labelled.read_labels(spark, path)


@_register("prediction_matrix", """with p as (select row_number() over (order by doc_id) - 1 "row", n_chars / 4.0 a, doc_id / 2.0 b from documents)
select "row", cast(1 as int) "column", cast(a as double) "value" from p union all select "row", 2, cast(b as double) from p""")
def prediction_matrix(spark, d):
    """A matrix file in long form, rows numbered by their places."""
    path = fresh_path(spark, "matrix")
    X.table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 4.0).alias("a"), (F.col("doc_id") / 2.0).alias("b")).coalesce(1).sortWithinPartitions("doc_id").select("a", "b").write.csv(path)
    return labelled.read_matrix(spark, path, 2)


@_register("read_stats", f"with {X.CHAR_DOCS} select count(*) filter (y > 0) n_pos, count(*) filter (y <= 0) n_neg, count(*) n, {q('avg(y)')} mean_y from e")
def read_stats(spark, d):
    return labelled.stats(X.char_docs(spark, d)).withColumn("mean_y", F.round("mean_y", 6) + 0.0)


@_register("centre_response", f"with {X.CHAR_DOCS} select doc_id, {q('y - avg(y) over ()')} y from e")
def centre_response(spark, d):
    return labelled.centre(X.char_docs(spark, d))[0].select("doc_id", R("y", "y"))


@_register("one_vs_rest_labels", f"""with {X.LANG_DOCS} select doc_id, cast(k as int) "class", case when "label" = k then 1.0::double else -1.0::double end y from e, range(1, 5) r(k)""")
def one_vs_rest_labels(spark, d):
    docs = X.lang_docs(spark, d).withColumn("class", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))
    return docs.select("doc_id", "class", labelled.one_vs_rest(F.col("label"), F.col("class")).alias("y"))


@_register("log2_trim_response", f"select doc_id, {q('log2(n_chars)')} y, md5(substr(text, 1, cast(greatest(length(text) - 20, 0) as int))) seq_md5 from documents where n_chars > 0")
def log2_trim_response(spark, d):
    docs = X.table(spark, d, "documents").where("n_chars > 0")
    return docs.select("doc_id", R(F.log2("n_chars"), "y"), F.md5(T.without_tail(F.col("text"), 20)).alias("seq_md5"))


@_register("inverse_log2", "select doc_id, round(pow(2.0, log2(n_chars)), 3) + 0.0 signal from documents where n_chars > 0")
def inverse_log2(spark, d):
    return X.table(spark, d, "documents").where("n_chars > 0").select("doc_id", (F.round(F.pow(F.lit(2.0), F.log2("n_chars")), 3) + 0.0).alias("signal"))


@_register("clean_markup_sequence", r"""with p as (select page_id, array_to_string(list_transform(regexp_split_to_array(html, '\r?\n'), lambda x: translate(regexp_replace(ltrim(x, ' '), '^\S+\s+', ''), ' ?', '')), '') s from pages)
select page_id, length(s) n, md5(s) seq_md5 from p""")
def clean_markup_sequence(spark, d):
    seq = F.array_join(F.transform(F.split("html", "\r?\n"), T.clean_hex_line), "")
    return X.table(spark, d, "pages").select("page_id", F.length(seq).cast("long").alias("n"), F.md5(seq).alias("seq_md5"))


# --- tokens and index ------------------------------------------------------------------------------------------------


@_register("char_tokens", f"with {X.CHAR_DOCS} select doc_id, length(seq) n, md5(array_to_string(string_split(seq, ''), '|')) toks_md5 from e")
def char_tokens(spark, d):
    toks = T.char_tokens(F.col("seq"))
    return X.char_docs(spark, d).select("doc_id", F.size(toks).cast("long").alias("n"), F.md5(F.array_join(toks, "|")).alias("toks_md5"))


@_register("byte_tokens", "select doc_id, cast(strlen(text) as bigint) n, md5(regexp_replace(hex(text), '(..)', '\\1|', 'g')) toks_md5 from documents where text <> ''")
def byte_tokens(spark, d):
    toks = T.byte_tokens(F.col("text"))
    return X.table(spark, d, "documents").where("text <> ''").select("doc_id", F.size(toks).cast("long").alias("n"), F.md5(F.concat(F.array_join(toks, "|"), F.lit("|"))).alias("toks_md5"))


@_register("word_tokens", f"with {X.EVENT_SEQS}, {WORDS} select doc_id, cast(i - 1 as int) pos, ws[i] tok from (select doc_id, ws, unnest(generate_series(1, len(ws))) i from w)")
def word_tokens(spark, d):
    return index.occurrences(X.event_seqs(spark, d), words=True)


_OCC = "o as (select doc_id, i - 1 pos, substr(seq, i, 1) tok from (select doc_id, seq, unnest(generate_series(1, length(seq))) i from e))"


@_register("inverted_index", f"with {X.CHAR_DOCS}, {_OCC} select tok, doc_id, count(*) n, cast(min(pos) as bigint) first_pos, cast(max(pos) as bigint) last_pos, cast(sum(pos) as bigint) sum_pos from o group by tok, doc_id")
def inverted_index(spark, d):
    places = index.inverted_index(X.char_docs(spark, d))
    total = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x)
    return places.select("tok", "doc_id", F.size("places").cast("long").alias("n"), F.col("places")[0].cast("long").alias("first_pos"), F.element_at("places", -1).cast("long").alias("last_pos"), total.alias("sum_pos"))


@_register("unigram_support", f"with {X.CHAR_DOCS}, {_OCC} select tok, count(distinct doc_id) support from o group by tok")
def unigram_support(spark, d):
    return index.support(X.char_docs(spark, d))


@_register("minsup_unigrams", f"with {X.CHAR_DOCS}, {_OCC} select tok, count(distinct doc_id) support from o group by tok having count(distinct doc_id) >= 50")
def minsup_unigrams(spark, d):
    return index.support(X.char_docs(spark, d), minsup=50)


@_register("bigram_children", f"""with {X.CHAR_DOCS}, {_OCC}, known as (select tok from o group by tok having count(distinct doc_id) >= 50)
select a.tok || b.tok ngram, count(*) n, count(distinct a.doc_id) support from o a join o b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where b.tok in (select tok from known) group by 1""")
def bigram_children(spark, d):
    docs = X.char_docs(spark, d)
    return frontier.child_counts(docs, known=index.support(docs, minsup=50))


@_register("wildcard_children", f"""with {X.EVENT_SEQS}, {WORDS}, o as (select doc_id, i pos, ws[i] tok from (select doc_id, ws, unnest(generate_series(1, len(ws))) i from w)),
x as (select a.doc_id, a.tok || ' ' || b.tok ngram, b.pos from o a join o b on a.doc_id = b.doc_id and b.pos = a.pos + 1 union all select a.doc_id, a.tok || ' *', b.pos from o a join o b on a.doc_id = b.doc_id and b.pos = a.pos + 1)
select ngram, count(*) n, count(distinct doc_id) support from x group by ngram""")
def wildcard_children(spark, d):
    found = index.occurrence_counts(index.children(index.first_level(X.event_seqs(spark, d), True), True, wildcard=True), True)
    return found.select(T.shown(F.col("ngram")).alias("ngram"), "n", "support")


@_register("next_tokens", f"with {X.EVENT_SEQS}, {WORDS}, o as (select doc_id, i - 1 pos, ws[i] tok from (select doc_id, ws, unnest(generate_series(1, len(ws))) i from w)) select tok, lead(tok) over (partition by doc_id order by pos) next, count(*) n from o group by all".replace("select tok, lead(tok) over (partition by doc_id order by pos) next, count(*) n from o group by all", "select tok, next, count(*) n from (select tok, lead(tok) over (partition by doc_id order by pos) next from o) group by all"))
def next_tokens(spark, d):
    found = index.following(index.occurrences(X.event_seqs(spark, d), words=True))
    return found.groupBy("tok", "next").agg(F.count("*").alias("n"))


@_register("shrunk_postings", f"with {X.EVENT_SEQS}, {WORDS} select distinct doc_id, ng ngram from ({word_grams_sql([(False, False)])})")
def shrunk_postings(spark, d):
    return index.shrink(index.postings(index.children(index.first_level(X.event_seqs(spark, d), True), True))).select("doc_id", "ngram")


@_register("ngram_support", f"with {X.CHAR_DOCS} select ng ngram, count(*) support from ({grams_sql((1, 2, 3))}) group by ng having count(*) >= {MINSUP}")
def ngram_support(spark, d):
    docs = X.char_docs(spark, d).select(T.char_tokens(F.col("seq")).alias("toks"), F.col("seq").alias("bare"))
    out = None
    for size in (1, 2, 3):
        part = index.grams_of(docs, size, toks="toks").groupBy("ngram").agg(F.count("*").alias("support")).where(f"support >= {MINSUP}")
        out = part if out is None else out.unionByName(part)
    return out


_LOOSE = [m for n in (3, 4) for m in T.masks(n, 2, 2)]
_TIGHT = [m for n in (3, 4) for m in T.masks(n, 2, 1)]


@_register("wildcard_constraint_filter", f"with {X.EVENT_SEQS}, {WORDS} select ng ngram, count(*) support from ({word_grams_sql(_TIGHT)}) group by ng")
def wildcard_constraint_filter(spark, d):
    docs = X.event_seqs(spark, d).select(T.word_tokens(F.col("seq")).alias("toks"))
    every = index.grams_of(docs, 3, True, (2, 2), "toks").unionByName(index.grams_of(docs, 4, True, (2, 2), "toks"))
    kept = index.within_gaps(every, 2, 1, words=True)
    return kept.groupBy(T.shown(F.col("ngram")).alias("ngram")).agg(F.count("*").alias("support"))


# --- losses, gradients, bounds ---------------------------------------------------------------------------------------

#: Loss and pull of each objective in SQL.
_SQL = {
    "squared": ("(y - score) * (y - score)", "2 * (y - score)"),
    "logistic": ("ln(1 + exp(-y * score))", "y / (1 + exp(y * score))"),
    "hinge": ("pow(greatest(1 - y * score, 0), 2)", "y * greatest(2 * (1 - y * score), 0)"),
}
for _kind in L.OBJECTIVES:

    @_register(f"doc_gradients_{_kind}", f"with {X.SCORED} select doc_id, {q(_SQL[_kind][1])} g from s")
    def _gradients(spark, d, kind=_kind):
        return X.scored(spark, d).select("doc_id", R(L.pull(kind, F.col("y"), F.col("score")), "g"))

    @_register(f"loss_{_kind}", f"with {X.SCORED} select {q(f'sum({_SQL[_kind][0]})')} loss from s")
    def _loss(spark, d, kind=_kind):
        return X.scored(spark, d).agg(R(F.sum(L.loss(kind, F.col("y"), F.col("score"))), "loss"))

    @_register(f"gradient_bounds_{_kind}", f"""with {X.SCORED}, g as (select doc_id, {_SQL[_kind][1]} g from s), p as ({grams_sql((1, 2))})
select ng ngram, {q('-sum(g)')} gradient, {q('-sum(case when g > 0 then g else 0 end)')} upos, {q('-sum(case when g > 0 then 0 else g end)')} uneg, count(*) support from p join g using (doc_id) group by ng""")
    def _bounds(spark, d, kind=_kind):
        state = X.scored(spark, d).select(T.char_tokens(F.col("seq")).alias("toks"), F.col("seq").alias("bare"), L.pull(kind, F.col("y"), F.col("score")).alias("g"))
        out = search.rank_all(state, search.SearchConfig(objective=kind), 2)
        return out.select("ngram", R("gradient", "gradient"), R("upos", "upos"), R("uneg", "uneg"), "support")

    _f0 = "(select avg(y) from e)" if _kind == "squared" else "0.0"

    @_register(f"best_ngram_{_kind}", f"""with {X.CHAR_DOCS}, s as (select doc_id, y, cast({_f0} as double) score from e), g as (select doc_id, {_SQL[_kind][1]} g from s), p as ({grams_sql(range(1, MAXPAT + 1))})
select ng ngram, sz size, {q('-sum(g)')} gradient, count(*) support from p join g using (doc_id) group by ng, sz having count(*) >= {MINSUP} order by round(abs(sum(g)), 9) desc, sz, ng limit 1""")
    def _best(spark, d, kind=_kind, minpat=1):
        return best(spark, X.char_docs(spark, d), search.SearchConfig(objective=kind, maxpat=MAXPAT, minpat=minpat, minsup=MINSUP))


def best(spark: SparkSession, docs: DataFrame, config: search.SearchConfig) -> DataFrame:
    """The search's winner as a row; squared error starts from the mean."""
    state = learn.prepare(docs, config.words)
    f = F.lit(learn.intercept_step(state, "squared") if config.objective == "squared" else 0.0)
    found = search.best_ngram(state.withColumn("g", L.pull(config.objective, F.col("y"), f)), config)
    rows = [] if found.ngram is None else [(found.ngram.replace(T.WILD, "*"), found.size, round(found.gradient, 6) + 0.0, found.support)]
    return spark.createDataFrame(rows, "ngram string, size int, gradient double, support long")


@_register("best_ngram_minpat", f"""with {X.CHAR_DOCS}, g as (select doc_id, 2 * (y - (select avg(y) from e)) g from e), p as ({grams_sql(range(3, MAXPAT + 1))})
select ng ngram, sz size, {q('-sum(g)')} gradient, count(*) support from p join g using (doc_id) group by ng, sz having count(*) >= {MINSUP} order by round(abs(sum(g)), 9) desc, sz, ng limit 1""")
def best_ngram_minpat(spark, d):
    return _best(spark, d, "squared", 3)


@_register("best_event_pattern", f"""with {X.EVENT_SEQS}, {WORDS}, g as (select doc_id, 2 * (y - (select avg(y) from e)) g from e), p as ({word_grams_sql([m for n in (1, 2, 3) for m in T.masks(n, 1, 1)])})
select ng ngram, sz size, {q('-sum(g)')} gradient, count(*) support from p join g using (doc_id) group by ng, sz order by round(abs(sum(g)), 9) desc, sz, replace(ng, '*', chr(57344)) limit 1""")
def best_event_pattern(spark, d):
    return best(spark, X.event_seqs(spark, d), search.SearchConfig(words=True, maxpat=3, gaps=(1, 1)))


@_register("best_ngram_any_size")
def best_ngram_any_size(spark, d):
    """Without a largest size: pruning alone ends the search (held against brute force in the tests)."""
    return best(spark, X.char_docs(spark, d), search.SearchConfig(minsup=MINSUP))


@_register("penalised_loss", f"with {X.SCORED} select {q('sum((y - score) * (y - score)) + (select 0.2 * sum(abs(weight)) + 0.4 * sum(weight * weight) from m)')} loss from s")
def penalised_loss(spark, d):
    extra = L.penalty([w for _, w in X.RULES], 1.0, 0.2)
    return X.scored(spark, d).agg(R(F.sum(L.loss("squared", F.col("y"), F.col("score"))) + extra, "loss"))


@_register("intercept_gradient", f"with {X.SCORED} " + " union all ".join(f"select '{k}' objective, {q(f'-sum({_SQL[k][1]})')} gradient from s" for k in L.OBJECTIVES))
def intercept_gradient(spark, d):
    sums = X.scored(spark, d).agg(*[(F.round(-F.sum(L.pull(k, F.col("y"), F.col("score"))), 6) + 0.0).alias(k) for k in L.OBJECTIVES])
    return sums.unpivot([], list(L.OBJECTIVES), "objective", "gradient")


@_register("prune_survivors", f"""with {X.CHAR_DOCS}, g as (select doc_id, 2 * (y - (select avg(y) from e)) g from e), p as ({grams_sql((1, 2))}),
b as (select ng, sz, -sum(g) gr, -sum(case when g > 0 then g else 0 end) up, -sum(case when g > 0 then 0 else g end) un, count(*) sup from p join g using (doc_id) group by ng, sz),
tau as (select max(round(abs(gr), 9)) t from b where sz = 1 and sup >= {MINSUP})
select ng ngram, sz size, sup support from b, tau where sup >= {MINSUP} and round(greatest(abs(up), abs(un)), 9) > t""")
def prune_survivors(spark, d):
    docs, _ = labelled.centre(X.char_docs(spark, d))
    state = docs.select(T.char_tokens(F.col("seq")).alias("toks"), F.col("seq").alias("bare"), (2 * F.col("y")).alias("g"))
    level = materialise(search.rank_all(state, search.SearchConfig(minsup=MINSUP), 2), "bounds")
    tau = level.where("size = 1").agg(F.max(F.round(F.abs("gradient"), 9))).first()[0]
    reach = F.greatest(F.abs("upos"), F.abs("uneg"))
    return level.where(F.round(reach, 9) > tau).select("ngram", "size", "support")


@_register("exact_step", f"with {X.CHAR_DOCS} select {q('avg(y)')} step, count(*) support from e where contains(seq, 'th')")
def exact_step(spark, d):
    state = learn.prepare(X.char_docs(spark, d), False)
    return state.where(T.holds(F.col("bare"), "th", False)).agg(R(F.avg(F.col("y") - F.col("f")), "step"), F.count("*").alias("support"))


@_register("convergence_rate", f"with {X.SCORED}, t as (select s.score, case when contains(seq, 'on') then 0.25 else 0 end move from s join e using (doc_id)) select {q('sum(abs(move)) / (1 + sum(abs(score)))')} rate from t")
def convergence_rate(spark, d):
    move = F.when(T.holds(F.col("seq"), "on", False), 0.25).otherwise(0.0)
    return X.scored(spark, d).agg(R(F.sum(F.abs(move)) / (1 + F.sum(F.abs("score"))), "rate"))


def _learn_rows(k: int) -> str:
    return " union all ".join(f"select {i} itr, '*INTERCEPT*' ngram, {q('d')} step from i{i} union all select {i}, ng, {q('step')} from b{i}" for i in range(1, k + 1))


def learn_blocks(k: int, start: str = "f0", name: str = "") -> list[str]:
    """``k`` steps of squared error as common table expressions; n-grams of each document are in p. The last one is f<k><name>."""
    blocks = []
    for i in range(1, k + 1):
        f, x = start if i == 1 else f"f{i - 1}{name}", f"{i}{name}"
        blocks.append(f"""i{x} as materialized (select avg(y - f) d from {f}), r{x} as materialized (select doc_id, y, f + d f from {f}, i{x}),
b{x} as materialized (select ng, sz, avg(y - f) step from p join r{x} using (doc_id) group by ng, sz having abs(sum(y - f)) > 1e-9 order by round(abs(sum(2 * (y - f))), 9) desc, sz, ng limit 1),
f{x} as materialized (select r.doc_id, r.y, r.f + case when p.ng is not null then b.step else 0 end f from r{x} r cross join b{x} b left join p on p.doc_id = r.doc_id and p.ng = b.ng)""")
    return blocks


def learn_sql(k: int, maxpat: int = MAXPAT) -> str:
    head = f"with {X.CHAR_DOCS}, p as materialized ({grams_sql(range(1, maxpat + 1))}), f0 as (select doc_id, y, cast(0 as double) f from e)"
    return ", ".join([head, *learn_blocks(k)]) + " " + _learn_rows(k)


def learn_ctes(k: int, maxpat: int) -> str:
    """The common table expressions of ``k`` steps, and st: itr, ngram, step (not rounded)."""
    rows = " union all ".join(f"select {i} itr, '{model.INTERCEPT}' ngram, d step from i{i} union all select {i}, ng, step from b{i}" for i in range(1, k + 1))
    return learn_sql(k, maxpat)[: -len(_learn_rows(k))].rstrip() + f", st(itr, ngram, step) as ({rows})"


#: Steps and largest n-gram of the models whose formats are queried.
K, SHORT = 3, 2


def learned(spark, d, **settings) -> learn.Learned:
    return learn.learn(X.char_docs(spark, d), learn.LearnConfig(**{"maxpat": SHORT, "max_iterations": K, "convergence": -1.0} | settings))


@_register("learn_k_iterations", learn_sql(3))
def learn_k_iterations(spark, d, k: int = 3):
    config = learn.LearnConfig(maxpat=MAXPAT, max_iterations=k, convergence=-1.0)
    steps = learn.learn(X.char_docs(spark, d), config).model.steps
    return spark.createDataFrame([(i // 2 + 1, g, round(s, 6) + 0.0) for i, (s, g) in enumerate(steps)], "itr int, ngram string, step double")


def learn_log_sql(k: int) -> str:
    blocks = learn_sql(k)[: -len(_learn_rows(k))]
    return blocks + " union all ".join(
        f"select cast({i} as int) \"Iteration\", (select ng from b{i}) symbol, {q(f'(select step from b{i})')} \"optimalStepLength\", {q('sum((f.y - f.f) * (f.y - f.f))')} loss, {q('sum(abs(f.f - r.f)) / (1 + sum(abs(r.f)))')} \"convRate\" from f{i} f join r{i} r using (doc_id)"
        for i in range(1, k + 1)
    )


@_register("learning_log", learn_log_sql(3))
def learning_log(spark, d, k: int = 3):
    """The log of three learning steps, written to a file and read back."""
    config = learn.LearnConfig(maxpat=MAXPAT, max_iterations=k, convergence=-1.0)
    path = fresh_path(spark, "log")
    sinks.write_log(spark, learn.log_frame(spark, learn.learn(X.char_docs(spark, d), config).log), path)
    return labelled.read_log(spark, path).select("Iteration", "symbol", R("optimalStepLength", "optimalStepLength"), R("loss", "loss"), R("convRate", "convRate"))


def _first_step_sql(kind: str) -> str:
    """At f = 0 and y = 1 or -1 the best constant has a closed form, for all documents and for those with an n-gram."""
    at = {"logistic": "ln(count(*) filter (y > 0) / cast(count(*) filter (y < 0) as double))", "hinge": "avg(y)"}[kind]
    return f"""with {X.CHAR_DOCS}, i as (select {at} d from e), s as (select doc_id, y, d score from e, i), g as (select doc_id, y, {_SQL[kind][1]} g from s), p as ({grams_sql(range(1, MAXPAT + 1))}),
b as (select ng, sum(g) g, count(*) support, {at} - (select d from i) step from p join g using (doc_id) group by ng, sz having count(*) >= {MINSUP} order by round(abs(sum(g)), 9) desc, sz, ng limit 1)
select '*INTERCEPT*' ngram, round(d, 4) + 0.0 step from i union all select ng, round(step, 4) + 0.0 from b"""


for _kind in ("logistic", "hinge"):

    @_register(f"learn_first_step_{_kind}", _first_step_sql(_kind))
    def _first_step(spark, d, kind=_kind):
        config = learn.LearnConfig(objective=kind, maxpat=MAXPAT, minsup=MINSUP, max_iterations=1, convergence=-1.0, tolerance=1e-6)
        steps = learn.learn(X.char_docs(spark, d), config).model.steps
        return spark.createDataFrame([(g, round(s, 4) + 0.0) for s, g in steps], "ngram string, step double")


@_register("validation_loss", f"with {X.SCORED} select {q('sum((y - score) * (y - score))')} loss from s")
def validation_loss(spark, d):
    m = model.SequenceModel([(w, g) for g, w in X.RULES], bias=X.OFFSET)
    return spark.createDataFrame([(round(learn.validation_loss(m, X.char_docs(spark, d)), 6) + 0.0,)], "loss double")


_C, _ALPHA = 1.0, 0.2


@_register("regularised_gradient", f"""with {X.SCORED}, p as ({grams_sql((1, 2, 3))}), b as (select ng, -sum(2 * (y - score)) g, count(*) support from p join s using (doc_id) group by ng)
select ng ngram, {q(f'g + {_C} * ({_ALPHA} * sign(weight) + {1 - _ALPHA} * weight)')} gradient, support from b join m on b.ng = m.ngram""")
def regularised_gradient(spark, d):
    config = search.SearchConfig(c=_C, alpha=_ALPHA)
    state = X.scored(spark, d).select(T.char_tokens(F.col("seq")).alias("toks"), F.col("seq").alias("bare"), L.pull("squared", F.col("y"), F.col("score")).alias("g"))
    level = search.penalised(search.rank_all(state, config, 3), dict(X.RULES), config)
    return level.where(F.col("ngram").isin([g for g, _ in X.RULES])).select("ngram", R("gradient", "gradient"), "support")


@_register("prefix_bound_correction", f"""with {X.SCORED}, p as ({grams_sql((1, 2))}),
b as (select ng, -sum(case when g > 0 then g else 0 end) up, -sum(case when g > 0 then 0 else g end) un from (select ng, 2 * (y - score) g from p join s using (doc_id)) group by ng),
x as (select b.ng, up, un, {_C} * ({_ALPHA} * sign(weight) + {1 - _ALPHA} * weight) extra from b join m on starts_with(m.ngram, b.ng))
select ng ngram, {q('greatest(max(abs(up)), max(abs(un)), max(abs(up + extra)), max(abs(un + extra)))')} reach from x group by ng""")
def prefix_bound_correction(spark, d):
    config = search.SearchConfig(c=_C, alpha=_ALPHA)
    state = X.scored(spark, d).select(T.char_tokens(F.col("seq")).alias("toks"), F.col("seq").alias("bare"), L.pull("squared", F.col("y"), F.col("score")).alias("g"))
    level = search.penalised(search.rank_all(state, config, 2), dict(X.RULES), config)
    affected = [p for g, _ in X.RULES for p in [*T.prefixes(g, False), g]]
    return level.where(F.col("ngram").isin(affected)).select("ngram", R("reach", "reach"))


_TH = "select count(*) filter (y > 0) a, count(*) filter (y < 0) b, count(*) n from e where contains(seq, 'th')"


@_register("line_search_step", f"""with {X.CHAR_DOCS}, c as ({_TH}) select 'logistic' objective, round(ln(a / cast(b as double)), 4) + 0.0 step, n support from c
union all select unnest(['hinge', 'squared']), round((a - b) / cast(n as double), 4) + 0.0, n from c""")
def line_search_step(spark, d):
    """The best step of the documents with an n-gram, which has a closed form at f = 0."""
    state = learn.prepare(X.char_docs(spark, d), False)
    rows = state.where(T.holds(F.col("bare"), "th", False))
    out = []
    for kind in L.OBJECTIVES:
        g, n = rows.agg(-F.sum(L.pull(kind, F.col("y"), F.col("f"))), F.count("*")).first()
        out.append((kind, round(float(learn.line_search(rows, kind, g or 0.0, n, tolerance=1e-6)), 4) + 0.0, n))
    return spark.createDataFrame(out, "objective string, step double, support long")


# --- models and scores -----------------------------------------------------------------------------------------------

_STEPS = learn_ctes(K, SHORT)


def _steps(spark, d) -> DataFrame:
    """The steps of a model learned from the documents, as it is saved."""
    path = fresh_path(spark, "model")
    sinks.save_model(learned(spark, d).model, spark, path)
    return spark.read.parquet(path).where("itr >= 0").select("itr", "ngram", "step")


@_register("model_weights", f"{_STEPS} select ngram, {q('sum(step)')} weight from st group by ngram")
def model_weights(spark, d):
    return model.roll_up(_steps(spark, d)).select("ngram", R("weight", "weight"))


_NORMS = "l1 as (select sum(abs(step)) l1 from st), wt as (select ngram, sum(step) w from st group by ngram)"


@_register("model_norms", f"{_STEPS}, {_NORMS} select {q('l1')} l1, {q('''sqrt(sum(w * w) filter (ngram <> '*INTERCEPT*'))''')} l2, {q('''sum(w) filter (ngram = '*INTERCEPT*')''')} intercept from l1, wt group by l1")
def model_norms(spark, d):
    return model.norms(_steps(spark, d)).select(R("l1", "l1"), R("l2", "l2"), R("intercept", "intercept"))


@_register("normalised_weights", f"{_STEPS}, {_NORMS} select ngram, {q('w / l1')} weight from wt, l1")
def normalised_weights(spark, d):
    steps = materialise(_steps(spark, d), "steps")
    l1 = model.norms(steps).first()["l1"]
    return model.normalised(model.roll_up(steps), l1).select("ngram", R("weight", "weight"))


def _numbers_of_lines(lines: DataFrame) -> DataFrame:
    """n, weight and name of the lines of a model."""
    parts = F.split("value", " ", 2)
    return labelled.numbered(lines).select((F.col("row") + 1).cast("int").alias("n"), R(parts[0].cast("double"), "weight"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("name"))


@_register("model_lines", f"""{_STEPS}, wt as (select ngram, sum(step) w from st group by ngram)
select cast(1 as int) n, 0.0::double weight, '' "name" union all select 2, {q('w')}, 'INTERCEPT' from wt where ngram = '*INTERCEPT*'
union all select cast(2 + row_number() over (order by w desc, ngram) as int), {q('w')}, ngram from wt where ngram <> '*INTERCEPT*'""")
def model_lines(spark, d):
    """A learned model as text, parsed again."""
    path = fresh_path(spark, "model-lines")
    sinks.write_model(learned(spark, d).model, spark, path)
    return _numbers_of_lines(spark.read.text(path))


@_register("step_lines", f"{_STEPS} select cast(row_number() over (order by itr, ngram <> '*INTERCEPT*') - 1 as bigint) itr, {q('step')} step, ngram from st")
def step_lines(spark, d):
    """The log of learning steps, written as lines and parsed again."""
    path = fresh_path(spark, "steps")
    sinks.write_steps(learned(spark, d).model, spark, path)
    return labelled.read_steps(spark, path).select("itr", R("step", "step"), "ngram")


@_register("saved_model", f"{_STEPS}, wt as (select ngram, sum(step) w from st group by ngram), sc as (select e.doc_id, 0.5::double + coalesce((select w from wt where ngram = '*INTERCEPT*'), 0) + coalesce(sum(w), 0) score from e left join wt on ngram <> '*INTERCEPT*' and contains(seq, ngram) group by e.doc_id) select doc_id, {q('score')} score from sc")
def saved_model(spark, d):
    """Scores by a learned model that was saved and opened with a threshold of -0.5."""
    path = fresh_path(spark, "model")
    sinks.save_model(learned(spark, d).model, spark, path)
    return sinks.open_model(spark, path, threshold=-0.5).transform(X.char_docs(spark, d)).select("doc_id", R("score", "score"))


@_register("score_docs", f"with {X.SCORED} select doc_id, {q('score')} score, n_rules from s")
def score_docs(spark, d):
    return X.scored(spark, d).select("doc_id", R("score", "score"), "n_rules")


@_register("score_probability", f"with {X.SCORED} select doc_id, {q('1 / (1 + exp(-score))')} probability from s")
def score_probability(spark, d):
    return X.scored(spark, d).select("doc_id", R("probability", "probability"))


@_register("score_docs_wildcard", f"""with {X.CHAR_DOCS}, m(ngram, weight) as (values {X.values(X.WILD_RULES)}), hit as (select doc_id, weight from e join m on regexp_matches(seq, replace(ngram, '*', '.')))
select e.doc_id, {q('coalesce(sum(weight), 0)')} score, count(weight) n_rules from e left join hit on e.doc_id = hit.doc_id group by e.doc_id""")
def score_docs_wildcard(spark, d):
    out = model.score(X.char_docs(spark, d), X.rules_frame(spark, X.WILD_RULES), 0.0)
    return out.select("doc_id", R("score", "score"), "n_rules")


@_register("score_events", f"""with {X.EVENT_SEQS}, m(ngram, weight) as (values {X.values(X.EVENT_RULES)}), hit as (select doc_id, weight from e join m on regexp_matches(' ' || seq || ' ', ' ' || replace(ngram, '*', '[^ ]+') || ' '))
select e.doc_id, {q('coalesce(sum(weight), 0)')} score, count(weight) n_rules from e left join hit on e.doc_id = hit.doc_id group by e.doc_id""")
def score_events(spark, d):
    out = model.score(X.event_seqs(spark, d), X.rules_frame(spark, X.EVENT_RULES), 0.0, words=True)
    return out.select("doc_id", R("score", "score"), "n_rules")


@_register("matched_rules", f"with {X.SCORED} select e.doc_id, coalesce(string_agg(ngram, ' ' order by ngram), '') rules from e left join hit on e.doc_id = hit.doc_id group by e.doc_id")
def matched_rules(spark, d):
    out = model.score(X.char_docs(spark, d), X.rules_frame(spark, X.RULES), 0.0, with_rules=True)
    return out.select("doc_id", F.array_join("rules", " ").alias("rules"))


@_register("feature_ids", f"with {X.SCORED}, k as (select ngram, row_number() over (order by ngram) id from m) select doc_id, string_agg(id || ':1.0', ' ' order by id) ids from hit join k using (ngram) group by doc_id")
def feature_ids(spark, d):
    names = F.array(*[F.lit(g) for g in sorted(g for g, _ in X.RULES)])
    found = model.with_matches(X.char_docs(spark, d), [(g, w) for g, w in X.RULES]).where(F.size("__hits") > 0)
    ids = F.array_sort(F.transform("__hits", lambda h: F.array_position(names, h["ngram"])))
    return found.select("doc_id", F.array_join(F.transform(ids, lambda i: F.concat(i.cast("string"), F.lit(":1.0"))), " ").alias("ids"))


#: Rules that many documents lack.
_RARE = [("zz", 0.5), ("qu", -0.25), ("sch", 0.125)]
_RARE_SQL = f"""{X.CHAR_DOCS}, m(ngram, weight) as (values {X.values(_RARE)}), hit as (select doc_id, weight from e join m on contains(seq, ngram)),
s as (select e.doc_id, cast({X.OFFSET} as double) + coalesce(sum(weight), 0) score, count(weight) n_rules from e left join hit on e.doc_id = hit.doc_id group by e.doc_id)"""


@_register("oov_docs", f"with {_RARE_SQL} select doc_id, {q('score')} score from s where n_rules = 0")
def oov_docs(spark, d):
    return model.unmatched(model.score(X.char_docs(spark, d), X.rules_frame(spark, _RARE), X.OFFSET)).select("doc_id", R("score", "score"))


@_register("oov_count", f"with {_RARE_SQL} select count(*) filter (n_rules = 0) n_oov, count(*) n from s")
def oov_count(spark, d):
    return model.count_unmatched(model.score(X.char_docs(spark, d), X.rules_frame(spark, _RARE), X.OFFSET))


@_register("stream_scores", _oracles["score_docs"].replace(", n_rules from s", " from s"))
def stream_scores(spark, d):
    """The same scores from a stream that reads the documents as files."""
    source, out = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    docs = X.char_docs(spark, d).select("doc_id", "seq")
    docs.write.parquet(source)
    m = model.SequenceModel([(w, g) for g, w in X.RULES], bias=X.OFFSET)
    scoring.start(spark.readStream.schema(docs.schema).parquet(source), m, out, fresh_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", R("score", "score"))


_LINES = {1: "cast(score as varchar)", 2: "cast(y as varchar) || ' ' || cast(score as varchar) || ' ' || cast(pr as varchar) || ' ' || md5(seq)"}
_LINES[4] = _LINES[2] + " || ' <instance> ' || rules || ' </instance>'"
_LINES[5] = "cast(y as varchar) || ' ' || ids"


@_register("prediction_lines", f"""with {X.SCORED}, k as (select ngram, row_number() over (order by ngram) id from m),
x as (select e.doc_id, e.y, e.seq, score, round(1 / (1 + exp(-score)), 4) pr, coalesce((select string_agg(ngram, ' ' order by ngram) from hit where hit.doc_id = e.doc_id), '') rules,
  coalesce((select string_agg(id || ':1.0', ' ' order by id) from hit join k using (ngram) where hit.doc_id = e.doc_id), '') ids from e join s using (doc_id)) """ + " union all ".join(f"select cast({v} as int) verbosity, {x} \"value\" from x" for v, x in _LINES.items()))
def prediction_lines(spark, d):
    """The prediction file of each verbosity, written and read back."""
    docs = X.char_docs(spark, d)
    scored = model.score(docs, X.rules_frame(spark, X.RULES), X.OFFSET, with_rules=True)
    numbers = F.array(*[F.lit(g) for g in sorted(g for g, _ in X.RULES)])
    ids = F.transform("rules", lambda g: F.array_position(numbers, g))
    scored = materialise(scored.withColumns({"ids": ids, "probability": F.round("probability", 4), "seq": F.md5("seq")}), "scored")
    out = None
    for v in _LINES:
        sinks.write_predictions(scored, path := fresh_path(spark, "predictions"), v)
        part = spark.read.text(path).select(F.lit(v).alias("verbosity"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@_register("train_lines", f"""with {X.LANG_DOCS} select '+' || "label" || ' ' || md5(seq) "value" from e""")
def train_lines(spark, d):
    return sinks.train_lines(X.lang_docs(spark, d).select("label", F.md5("seq").alias("seq")))


# --- evaluation ------------------------------------------------------------------------------------------------------


@_register("regression_metrics", f"""with {X.SCORED}, t as (select avg(y) my from s),
a as (select avg(pow(score - y, 2)) mse, avg(abs(score - y)) mae, sum(pow(score - y, 2)) sr, sum(pow(y - my, 2)) st, sum(abs(score - y)) ar, sum(abs(y - my)) atot, corr(score, y) pe from s, t)
select {q('mse')} mse, {q('sqrt(mse)')} rmse, {q('mae')} mae, {q('sr / st')} rse, {q('sqrt(sr / st)')} root_rse, {q('1 - sr / st')} r2, {q('ar / atot')} rae, {q('pe')} pearson from a""")
def regression_metrics(spark, d):
    out = evaluate.regression(X.scored(spark, d))
    return out.select(*[R(c, c) for c in out.columns])


_COUNTS = "c as (select count(*) filter (y > 0 and score > 0) tp, count(*) filter (y <= 0 and score > 0) fp, count(*) filter (y > 0 and score <= 0) fn, count(*) filter (y <= 0 and score <= 0) tn from s)"


@_register("confusion_counts", f"with {X.SCORED}, {_COUNTS} select * from c")
def confusion_counts(spark, d):
    return evaluate.counts(X.scored(spark, d))


_SAFE = lambda a, b: f"(case when {b} <> 0 then ({a}) / cast({b} as double) else 0 end)"


@_register("class_metrics", f"""with {X.SCORED}, {_COUNTS}, r as (select *, {_SAFE('tp', '(tp + fp)')} pr, {_SAFE('tp', '(tp + fn)')} re, {_SAFE('tn', '(tn + fp)')} sp, {_SAFE('tp + tn', '(tp + fp + fn + tn)')} ac, {_SAFE('fp + fn', '(tp + fp + fn + tn)')} er from c)
select tp, fp, fn, tn, {q('pr')} "precision", {q('re')} recall, {q('sp')} specificity, {q('ac')} accuracy, {q('er')} error, {q('(fn / cast(tp + fn as double) + fp / cast(tn + fp as double)) / 2')} balanced_error,
{q(_SAFE('2 * pr * re', '(pr + re)'))} f1, {q(_SAFE('2 * sp * re', '(sp + re)'))} fss from r""")
def class_metrics(spark, d):
    out = evaluate.classification(evaluate.counts(X.scored(spark, d)))
    return out.select(*[c if c in ("tp", "fp", "fn", "tn") else R(c, c) for c in out.columns])


def _written(spark, report: DataFrame) -> DataFrame:
    sinks.write_report(report, path := fresh_path(spark, "report"))
    return spark.read.schema(report.schema).json(path)


@_register("regression_report", _oracles["regression_metrics"])
def regression_report(spark, d):
    """The measures, written as a report and read back."""
    return _written(spark, regression_metrics(spark, d))


@_register("class_report", _oracles["class_metrics"])
def class_report(spark, d):
    return _written(spark, class_metrics(spark, d))


_GROUPS = """gr as (select score, count(*) filter (y > 0) p, count(*) filter (y <= 0) n from s group by score),
cu as (select score, p, n, coalesce(sum(p) over (order by score desc rows between unbounded preceding and 1 preceding), 0) bp, coalesce(sum(n) over (order by score desc rows between unbounded preceding and 1 preceding), 0) bn from gr),
to_ as (select sum(p) pp, sum(n) nn from gr)"""


@_register("auc", f"with {X.SCORED}, {_GROUPS} select {q('100.0 * sum(n * (2 * bp + p) / 2.0) / (max(pp) * max(nn))')} auc from cu, to_")
def auc(spark, d):
    return evaluate.auc(X.scored(spark, d)).select(R("auc", "auc"))


@_register("auc50", f"""with {X.SCORED}, {_GROUPS}, br as (select bn x, bp yy, lead(bn) over (order by score desc) nx, lead(bp) over (order by score desc) ny from cu where bn < 50),
area as (select sum(case when nx is null then (least(nn, 50) - x) * (pp + yy) / 2.0 else (nx - x) * (ny + yy) / 2.0 end) a, max(pp) pp from br, to_) select {q('100.0 * a / (50 * pp)')} auc50 from area""")
def auc50(spark, d):
    return evaluate.auc50(X.scored(spark, d)).select(R("auc50", "auc50"))


@_register("tune_threshold", f"""with {X.SCORED}, gr as (select score, count(*) filter (y > 0) p, count(*) filter (y <= 0) n from s group by score),
cu as (select score, lag(score) over (order by score) lo, coalesce(sum(p) over (order by score rows between unbounded preceding and 1 preceding), 0) bp, sum(n) over (order by score rows between current row and unbounded following) an from gr),
th as (select case when lo is null then cast('-infinity' as double) else (lo + score) / 2 end threshold, bp + an errors from cu union all select max(score) + 1, sum(p) from gr)
select {q('threshold')} threshold, cast(errors as bigint) errors from th order by errors, threshold limit 1""")
def tune_threshold(spark, d):
    return evaluate.tune(X.scored(spark, d)).select(R("threshold", "threshold"), "errors")


_PLACE = """pl as (select doc_id, quality, row_number() over (partition by quality order by md5(cast(doc_id as varchar)), doc_id) - 1 pl from labels),
fo as (select doc_id, quality, cast(pl % 4 as int) fold, floor(pl / 4) % 10 = 0 held from pl)"""


@_register("stratified_folds", f"with {_PLACE} select doc_id, quality, fold, held from fo")
def stratified_folds(spark, d):
    return evaluate.stratified_folds(X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", "quality", "fold", "held")


@_register("fold_disjointness", f"""with {_PLACE}, x as (select k, case when fold = k then 'test' when held then 'validation' else 'train' end split, doc_id from fo, range(0, 4) r(k))
select cast(k as int) k, split, count(*) n, count(distinct doc_id) ids, cast(0 as bigint) shared from x group by k, split""")
def fold_disjointness(spark, d):
    folds = materialise(stratified_folds(spark, d), "folds")
    out = None
    for k in range(4):
        part = evaluate.splits(folds, k).select(F.lit(k).alias("k"), "split", "doc_id")
        out = part if out is None else out.unionByName(part)
    out = materialise(out, "splits")
    twice = out.groupBy("k", "doc_id").agg(F.count_distinct("split").alias("s")).where("s > 1").groupBy("k").agg(F.count("*").alias("shared"))
    table = out.groupBy("k", "split").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    return table.join(twice, "k", "left").select("k", "split", "n", "ids", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


@_register("fold_files", f"""with {_PLACE}, x as (select case when fold = 1 then 'test' when held then 'validation' else 'train' end split, doc_id, quality, fold from fo)
select fold, split, doc_id, quality from x""")
def fold_files(spark, d):
    """Fold and split of each row, written by folder and read back."""
    sinks.write_folds(evaluate.splits(stratified_folds(spark, d), 1).drop("held"), path := fresh_path(spark, "folds"))
    return spark.read.csv(path, header=True, schema="doc_id long, quality int, fold int, split string").select("fold", "split", "doc_id", "quality")


@_register("submission_file", """select cast(doc_id as varchar) "TF_Id", lang "ArrayType", round(pow(2.0, log2(n_chars)), 3) + 0.0 "Signal_Mean" from documents where n_chars > 0""")
def submission_file(spark, d):
    """Predictions on the log scale as a compressed, tab-separated file, read back."""
    docs = X.table(spark, d, "documents").where("n_chars > 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("array_type"), F.log2("n_chars").alias("prediction"))
    sinks.write_submission(docs, path := fresh_path(spark, "submission"))
    rows = spark.read.option("sep", "\t").csv(path, header=True, schema="TF_Id string, ArrayType string, Signal_Mean double")
    return rows.withColumn("Signal_Mean", F.round("Signal_Mean", 3) + 0.0)


#: Literal rules of four classes.
_CLASS_RULES = [(1, "sch", 0.5), (1, "ung", 0.25), (2, "th", 0.5), (2, "sh", 0.25), (3, "ci", 0.5), (3, "ado", 0.25), (4, "eau", 0.5), (4, "oi", 0.25)]
_CLASS_SQL = f"""{X.LANG_DOCS}, cm(k, ngram, weight) as (values {X.values(_CLASS_RULES)}),
cs as (select e.doc_id, e."label", c.k, coalesce(sum(weight), 0) score from e cross join range(1, 5) c(k) left join cm on cm.k = c.k and contains(seq, ngram) group by e.doc_id, e."label", c.k),
pr as (select doc_id, any_value("label") "label", cast(arg_max(k, score * 1000 - k) as int) predicted from cs group by doc_id)"""


def _predicted(spark, d) -> DataFrame:
    docs = X.lang_docs(spark, d).select("doc_id", "label", "seq")
    return multiclass.predict(docs, {k: {g: w for c, g, w in _CLASS_RULES if c == k} for k in (1, 2, 3, 4)}).drop("seq")


@_register("multiclass_argmax", f"""with {_CLASS_SQL} select doc_id, "label", predicted from pr""")
def multiclass_argmax(spark, d):
    return _predicted(spark, d)


@_register("multiclass_confusion", f"""with {_CLASS_SQL} select "label", {', '.join(f'count(*) filter (predicted = {k}) p{k}' for k in (1, 2, 3, 4))} from pr group by "label" """)
def multiclass_confusion(spark, d):
    return multiclass.confusion(_predicted(spark, d), [1, 2, 3, 4])


@_register("fold_accuracy", f"""with {_CLASS_SQL}, pl as (select *, cast((row_number() over (partition by "label" order by md5(cast(doc_id as varchar)), doc_id) - 1) % 4 as int) fold from pr)
select fold, {q('avg(case when predicted = "label" then 1.0 else 0.0 end)')} accuracy, count(*) n from pl group by rollup (fold)""")
def fold_accuracy(spark, d):
    folds = evaluate.stratified_folds(_predicted(spark, d), "doc_id", "label")
    return multiclass.fold_accuracy(folds).select("fold", R("accuracy", "accuracy"), "n")


@_register("class_gradients", f"""with {X.LANG_DOCS}, p as ({grams_sql((2,))}) select ng ngram, count(*) support, {', '.join(q(f'-sum(case when "label" = {k} then 2.0::double else -2.0::double end)') + f' class{k}' for k in (1, 2, 3, 4))} from p join e using (doc_id) group by ng""")
def class_gradients(spark, d):
    out = multiclass.class_gradients(X.lang_docs(spark, d), [1, 2, 3, 4], 2, learn.LearnConfig())
    return out.select("ngram", "support", *[R(f"class{k}", f"class{k}") for k in (1, 2, 3, 4)])


def _one_vs_rest_sql() -> str:
    blocks = [f"with {X.LANG_DOCS}, p as materialized ({grams_sql((1, 2))})"]
    for k in (1, 2, 3, 4):
        blocks.append(f"""z{k} as (select doc_id, case when "label" = {k} then 1.0::double else -1.0::double end y, cast(0 as double) f from e)""")
        blocks += learn_blocks(2, f"z{k}", f"_{k}")
    scores = " union all ".join(f"select doc_id, {k} k, f from f2_{k}" for k in (1, 2, 3, 4))
    return ", ".join(blocks) + f""", c as ({scores}) select e.doc_id, "label", cast(arg_max(k, round(f, 9) * 1000000 - k) as int) predicted from c join e using (doc_id) group by e.doc_id, "label" """


@_register("one_vs_rest_models", _one_vs_rest_sql())
def one_vs_rest_models(spark, d):
    """Two learning steps for each language, scored and chosen among."""
    docs = X.lang_docs(spark, d)
    models = multiclass.learn_classes(docs, [1, 2, 3, 4], learn.LearnConfig(maxpat=2, max_iterations=2, convergence=-1.0))
    return multiclass.predict_models(docs, models).select("doc_id", "label", "predicted")


@_register("positional_zip", """with a as (select row_number() over (order by doc_id) place, doc_id, n_chars from documents), b as (select row_number() over (order by doc_id) place, doc_id, quality from labels)
select a.doc_id, n_chars, b.doc_id right_doc_id, quality right_quality from a join b using (place)""")
def positional_zip(spark, d):
    left = X.table(spark, d, "documents").select("doc_id", "n_chars")
    return evaluate.zip_rows(left, X.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").drop("place")


def _curve_sql(k: int) -> str:
    blocks = [f"with {X.LANG_DOCS}, p as materialized ({grams_sql((1, 2))})"]
    for c in (1, 2, 3, 4):
        blocks.append(f"""z{c} as (select doc_id, case when "label" = {c} then 1.0::double else -1.0::double end y, cast(0 as double) f from e)""")
        blocks += learn_blocks(k, f"z{c}", f"_{c}")
    rows = " union all ".join(f"select cast({c} as int) c, cast({i} as int) iteration, (select sum((y - f) * (y - f)) from f{i}_{c}) loss" for c in (1, 2, 3, 4) for i in range(1, k + 1))
    return ", ".join(blocks) + f""", lo as ({rows}) select c "class", iteration, {q('loss / max(loss) over (partition by c)')} relative, {q('lag(loss) over (partition by c order by iteration) - loss')} change from lo"""


@_register("normalised_loss_curve", _curve_sql(3))
def normalised_loss_curve(spark, d):
    """The logs of one-vs-rest learning, written and read back, with each class's loss in shares of its largest."""
    models = multiclass.learn_classes(X.lang_docs(spark, d), [1, 2, 3, 4], learn.LearnConfig(maxpat=2, max_iterations=3, convergence=-1.0))
    rows = [(k, r["Iteration"], r["loss"]) for k, x in models.items() for r in x.log]
    spark.createDataFrame(rows, "class int, iteration int, loss double").write.csv(path := fresh_path(spark, "logs"), header=True)
    log = spark.read.csv(path, header=True, schema="class int, iteration int, loss double")
    return evaluate.loss_curve(log).select("class", "iteration", R("relative", "relative"), R("change", "change"))


# --- generator and baselines -----------------------------------------------------------------------------------------


@_register("toy_sequences")
def toy_sequences(spark, d):
    planted = generate.motifs(spark, 2, 5, seed=1)
    return generate.toy_sequences(spark, 200, 50, 4, planted, seed=1).select("doc_id", "seq", R("y", "y"), F.array_join("contains", " ").alias("contains"), "test")


@_register("motif_recovery")
def motif_recovery(spark, d):
    planted = generate.motifs(spark, 2, 5, seed=1)
    docs = materialise(generate.toy_sequences(spark, 400, 50, 4, planted, seed=1), "toy")
    learned = learn.learn(docs, learn.LearnConfig(maxpat=6, max_iterations=6, minsup=3))
    return generate.recovered(planted, learned.model.rules(spark))


@_register("ngram_vectoriser", f"with {X.CHAR_DOCS} select doc_id, count(*) n_features from ({grams_sql((1, 2))}) group by doc_id")
def ngram_vectoriser(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows, _ = baselines.vectorise(X.char_docs(spark, d), range(1, 3))
    return rows.select("doc_id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_features"))


def _vectors(spark, d, sizes=range(1, 4)):
    rows, names = baselines.vectorise(X.char_docs(spark, d), sizes)
    return materialise(rows.select("doc_id", "y", "grams", "features"), "features"), names


def _baseline(kind: str):
    def run(spark, d):
        rows, _ = _vectors(spark, d)
        return baselines.fit(kind, rows, rows.count()).transform(rows).select("doc_id", F.col("prediction").alias("score"))

    return run


for _kind in ("ols", "ridge", "enet"):
    _register(f"{_kind}_baseline")(_baseline(_kind))


@_register("svr_baseline")
def svr_baseline(spark, d):
    rows, names = _vectors(spark, d)
    rows = materialise(baselines.sparse(rows, names), "sparse")
    w, b = baselines.svr(rows, rows.count(), size=len(names))
    return spark.createDataFrame([(g, float(x)) for g, x in [*zip(names, w, strict=True), (model.INTERCEPT, b)]], "ngram string, weight double")


@_register("baseline_conditions", f"""with {X.CHAR_DOCS}, t as (select ng, count(*) support from ({grams_sql((1, 2, 3))}) group by ng union all select '{model.INTERCEPT}', count(*) from e), k(kind) as (values ('ols'), ('ridge'), ('enet'))
select kind, ng ngram, support, 0.0::double gap from t, k""")
def baseline_conditions(spark, d):
    """How far each baseline is from its optimum's conditions, feature by feature (in SQL: not at all, to four digits)."""
    rows, names = _vectors(spark, d)
    n, out = rows.count(), None
    for kind in ("ols", "ridge", "enet"):
        part = baselines.optimality(kind, baselines.fit(kind, rows, n), rows, names, n)
        part = part.select(F.lit(kind).alias("kind"), "ngram", "support", (F.round("gap", 4) + 0.0).alias("gap"))
        out = part if out is None else out.unionByName(part)
    return out


@_register("baseline_report")
def baseline_report(spark, d):
    """The measures of each baseline, and its features of the largest and smallest weight."""
    rows, names = _vectors(spark, d, range(1, 3))
    n, out = rows.count(), None
    for kind in ("ols", "ridge", "enet"):
        fitted = baselines.fit(kind, rows, n)
        part = baselines.report(kind, fitted.transform(rows).withColumnRenamed("prediction", "score"), names, fitted.coefficients)
        out = part if out is None else out.unionByName(part)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn three rules on the documents and score them."""
    docs = X.char_docs(spark, sf_dir)
    learned = learn.learn(docs, learn.LearnConfig(maxpat=MAXPAT, max_iterations=3, convergence=-1.0))
    return learned.model.transform(docs).select("doc_id", "y", "score", "n_rules")


def queries() -> dict:
    from seqforge.plans import learning  # noqa: F401  registers its queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)
