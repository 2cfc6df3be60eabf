"""The engine against brute force, hand cases and its own invariants."""

import itertools
import math
import os
import pickle
import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqforge import session
from seqforge.functions import arrow
from seqforge.functions import loss as L
from seqforge.functions import text as T
from seqforge.operators import baselines, evaluate, frontier, generate, index, learn, matcher, model, multiclass, postings, search, sweep
from seqforge.operators.model import INTERCEPT
from seqforge.plans import fixtures as X
from seqforge.sources import labelled, sinks, stream
from seqforge.streaming import scoring


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, seq string, y double")


def grams(tokens, size, mask=None):
    out = set()
    for i in range(len(tokens) - size + 1):
        out.add(tuple(None if mask and mask[k] else tokens[i + k] for k in range(size)))
    return out


def brute_best(rows, maxpat, minsup, gaps=(0, 0), minpat=1):
    found = {}
    for _, seq, g in rows:
        for size in range(1, min(maxpat, len(seq)) + 1):
            for mask in T.masks(size, *T.gap_limits(*gaps)):
                for s in grams(seq, size, mask):
                    key = "".join(T.WILD if t is None else t for t in s)
                    a = found.setdefault((size, key), [0.0, 0])
                    a[0] -= g
                    a[1] += 1
    fits = [(-round(abs(g), 9), size, key) for (size, key), (g, n) in found.items() if n >= minsup and size >= minpat and round(abs(g), 9) > 0]
    return min(fits) if fits else None


@pytest.mark.parametrize("seed,gaps,minsup,minpat", [(0, (0, 0), 1, 1), (1, (0, 0), 3, 2), (2, (1, 1), 1, 1), (3, (2, 1), 2, 1)])
def test_pruned_search_equals_brute_force(spark, seed, gaps, minsup, minpat):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), float(rng.choice([-1, 1]))) for i in range(25)]
    state = learn.prepare(docs_of(spark, rows), False).withColumn("g", F.col("y"))
    config = search.SearchConfig(maxpat=5, minsup=minsup, gaps=gaps, minpat=minpat)
    got = search.best_ngram(state, config)
    want = brute_best(rows, 5, minsup, gaps, minpat)
    assert (-round(abs(got.gradient), 9), got.size, got.ngram) == want


def test_search_without_size_limit_ends(spark):
    rows = [(0, "abcabcabc", 1.0), (1, "abcabc", 1.0), (2, "cba", -1.0), (3, "", -1.0)]
    state = learn.prepare(docs_of(spark, rows), False).withColumn("g", F.col("y"))
    got = search.best_ngram(state, search.SearchConfig())
    assert (got.ngram, got.support) == ("ab", 2)


def test_masks_and_gap_limits():
    assert T.gap_limits(0, 0) == (0, 0) and T.gap_limits(0, 2)[1] == 2 and T.gap_limits(3, 0) == (3, 3) and T.gap_limits(2, 5) == (2, 2)
    assert T.masks(4, 2, 1) == [(False, False, False, False), (False, False, True, False), (False, True, False, False)]


def test_hand_cases_of_tokens_and_support(spark):
    docs = docs_of(spark, [(0, "abcab", 1.0), (1, "bcaé", 1.0), (2, "", 1.0), (3, "ab", 1.0)])
    assert {r.tok: r.support for r in index.support(docs).collect()} == {"a": 3, "b": 3, "c": 2, "é": 1}
    found = index.shrink(index.postings(index.children(index.first_level(docs))))
    assert {r[0]: r[1] for r in found.groupBy("ngram").count().collect()} == {"ab": 2, "bc": 2, "ca": 2, "aé": 1}


def test_lines(spark):
    lines = spark.createDataFrame([("1.5abc\tx y",), ("-2 q\r",), ("; c",), ("",), ("noDelim",), ("1",), ("+3\t",)], "value string")
    got = sorted((r.y, r.seq, r.malformed) for r in labelled.parse_lines(lines).collect())
    assert got == sorted([(1.5, "x y", False), (-2.0, "q", False), (0.0, "noDelim", True), (1.0, "1", True)])
    assert labelled.parse_lines(lines, drop_empty=False).count() == 5


def test_wildcard_scores(spark):
    docs = docs_of(spark, [(1, "abc", 0.0), (2, "axc", 0.0), (3, "ac", 0.0), (4, "aaa", 0.0)])
    m = model.SequenceModel([(2.0, f"a{T.WILD}c"), (0.5, "a"), (0.25, INTERCEPT)], bias=1.0, gaps=(1, 1))
    got = {r.doc_id: (r.score, r.n_rules) for r in m.transform(docs).collect()}
    assert got == {1: (3.75, 2), 2: (3.75, 2), 3: (1.75, 1), 4: (1.75, 1)}
    streamed = {r.doc_id: r.score for r in scoring.score_stream(docs, m).collect()}
    assert streamed == {k: v[0] for k, v in got.items()}


@pytest.mark.parametrize("words", [False, True])
def test_rules_of_the_tree_equal_rules_looked_for(spark, words):
    rng = random.Random(1)
    sep = " " if words else ""
    docs = docs_of(spark, [(i, sep.join(rng.choice(["a", "b", "é", "😀", "."]) for _ in range(rng.randint(0, 12))), 0.0) for i in range(60)] + [(99, None, 0.0)])
    rules = spark.createDataFrame([(sep.join(p), 0.5) for p in (["a"], ["a", "b"], ["😀", "é", "."], [".", T.WILD, "a"], ["a", "b", "é", "a"])], "ngram string, weight double")
    found = {(r.doc_id, r.ngram) for r in model.matches(docs, rules, words).collect()}
    bare = docs.select("doc_id", T.bare(F.coalesce("seq", F.lit("")), words).alias("bare"))
    looked_for = {(r.doc_id, g) for g in [r.ngram for r in rules.collect()] for r in bare.where(T.holds(F.col("bare"), g, words)).collect()}
    assert len(found) > 20 and found == looked_for


def test_word_rules_do_not_join_words(spark):
    docs = docs_of(spark, [(1, "ab  c", 0.0), (2, "a bc", 0.0), (3, "x ab y c", 0.0)])
    m = model.SequenceModel([(1.0, "ab c"), (4.0, f"ab {T.WILD} c")], words=True, gaps=(1, 1))
    assert {r.doc_id: r.score for r in m.transform(docs).collect()} == {1: 1.0, 2: 0.0, 3: 4.0}
    assert {r.doc_id: r.score for r in scoring.score_stream(docs, m).collect()} == {1: 1.0, 2: 0.0, 3: 4.0}


def brute_learn(rows, k, maxpat):
    f = [0.0] * len(rows)
    steps = []
    for _ in range(k):
        d = sum(y - v for (_, _, y), v in zip(rows, f)) / len(rows)
        f = [v + d for v in f]
        steps.append((INTERCEPT, round(d, 6)))
        best = brute_best([(i, s, 2 * (y - v)) for (i, s, y), v in zip(rows, f)], maxpat, 1)
        has = [best[2] in s for _, s, _ in rows]
        step = sum(y - v for (_, _, y), v, h in zip(rows, f, has) if h) / sum(has)
        f = [v + step * h for v, h in zip(f, has)]
        steps.append((best[2], round(step, 6)))
    return steps


def test_learning_equals_brute_force_and_loss_falls(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(8)), rng.gauss(0, 1)) for i in range(30)]
    got = learn.learn(docs_of(spark, rows), learn.LearnConfig(maxpat=3, max_iterations=3, convergence=-1.0))
    assert [(g, round(s, 6)) for s, g in got.model.steps] == brute_learn(rows, 3, 3)
    losses = [r["loss"] for r in got.log]
    assert losses == sorted(losses, reverse=True)


@pytest.mark.parametrize("kind", ["logistic", "hinge"])
def test_other_objectives_lower_their_loss(spark, kind):
    rows = [(i, s, y) for i, (s, y) in enumerate([("aab", 1.0), ("abb", 1.0), ("ccc", -1.0), ("bcc", -1.0), ("aac", 1.0)])]
    got = learn.learn(docs_of(spark, rows), learn.LearnConfig(objective=kind, maxpat=2, max_iterations=3, convergence=-1.0, c=0.1))
    reg = [r["regLoss"] for r in got.log]
    start = 5 * (math.log(2) if kind == "logistic" else 1.0)
    assert reg[0] < start and reg == sorted(reg, reverse=True)


def exact_step(kind, rows, f, has, penalty):
    """The step that lowers the penalised loss of the documents most, by ternary search."""
    z = lambda s: sum(brute_loss(kind, y, v + s) for (_, _, y), v, h in zip(rows, f, has) if h) + penalty(s)
    low, high = -40.0, 40.0
    for _ in range(200):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if z(a) < z(b) else (a, high)
    return (low + high) / 2


def brute_loss(kind, y, f):
    return {"logistic": lambda: math.log1p(math.exp(-y * f)), "hinge": lambda: max(0.0, 1 - y * f) ** 2}[kind]()


@pytest.mark.parametrize("kind,c", [("logistic", 0.0), ("hinge", 0.0), ("logistic", 0.5), ("hinge", 0.5)])
def test_steps_of_other_objectives_are_the_best_ones(spark, kind, c):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abc") for _ in range(6)), float(rng.choice([-1, 1, 1]))) for i in range(60)]
    got = learn.learn(docs_of(spark, rows), learn.LearnConfig(objective=kind, maxpat=2, minsup=8, max_iterations=3, convergence=-1.0, c=c, alpha=0.2, tolerance=1e-7))
    f, weights = [0.0] * len(rows), {}
    steps = iter(got.model.steps)
    for delta, name in steps:
        assert name == INTERCEPT
        assert abs(delta - exact_step(kind, rows, f, [True] * len(rows), lambda s: 0.0)) < 1e-3
        f = [v + delta for v in f]
        pulls = [{"logistic": y / (1 + math.exp(y * v)), "hinge": y * max(0.0, 2 * (1 - y * v))}[kind] for (_, _, y), v in zip(rows, f)]
        step, gram = next(steps)
        gains = {g: (abs(sum(p for (_, s, _), p in zip(rows, pulls) if g in s) - (L.penalty_gradient(weights[g], c, 0.2) if c and g in weights else 0.0))) for g in {s[i : i + n] for _, s, _ in rows for n in (1, 2) for i in range(7 - n)} if sum(g in s for _, s, _ in rows) >= 8}
        assert gains[gram] >= max(gains.values()) - 1e-6
        has, w = [gram in s for _, s, _ in rows], weights.get(gram, 0.0)
        best = exact_step(kind, rows, f, has, lambda s: L.penalty([w + s], c, 0.2) - L.penalty([w], c, 0.2))
        assert abs(step - best) < 1e-3
        weights[gram] = w + step
        f = [v + step * h for v, h in zip(f, has)]


def test_candidates_change_the_work_and_not_the_winner(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("abcde") for _ in range(12)), float(rng.choice([-1, 1]))) for i in range(80)]
    state = learn.prepare(docs_of(spark, rows), False).withColumn("g", F.col("y"))
    config = search.SearchConfig(maxpat=4, minsup=2)
    cold = search.best_ngram(state, config)
    warm = search.best_ngram(state, config, candidates=[cold.ngram, "zz", "a"])
    assert (warm.ngram, warm.gradient, warm.support) == (cold.ngram, cold.gradient, cold.support)
    assert sum(x[2] for x in warm.counters) <= sum(x[2] for x in cold.counters)
    depth = search.best_ngram(state, search.SearchConfig(maxpat=4, minsup=2, traversal="dfs"))
    assert depth.ngram == cold.ngram


@pytest.mark.parametrize("in_row", [0, 10_000])
def test_survivors_in_the_row_or_joined(spark, monkeypatch, in_row):
    monkeypatch.setattr(search, "IN_ROW", in_row)
    rows = [(i, s, y) for i, (s, y) in enumerate([("abcab", 1.0), ("bcab", 1.0), ("cccab", -1.0), ("bca", 1.0)] * 3)]
    state = learn.prepare(docs_of(spark, rows), False).withColumn("g", F.col("y"))
    got = search.best_ngram(state, search.SearchConfig(maxpat=4))
    assert (-round(abs(got.gradient), 9), got.size, got.ngram) == brute_best(rows, 4, 1)


def test_early_stopping_on_validation(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(6)), rng.gauss(0, 1)) for i in range(30)]
    other = [(i, "".join(rng.choice("abcdefgh") for _ in range(6)), rng.gauss(0, 1)) for i in range(30)]
    config = learn.LearnConfig(maxpat=2, max_iterations=12, convergence=-1.0, validation="previous")
    got = learn.learn(docs_of(spark, rows), config, validation=docs_of(spark, other))
    assert got.reason == "validation loss" and len(got.log) in (6, 11)
    m = model.SequenceModel(got.model.steps[:12])
    first, later = (learn.validation_loss(model.SequenceModel(got.model.steps[: 2 * n]), docs_of(spark, other)) for n in (len(got.log) - 5, len(got.log)))
    assert later > first and m.steps


def test_models_of_classes_over_folds(spark):
    rows = [(i, s, k, i % 2) for i, (s, k) in enumerate([("aab", 1), ("aba", 1), ("bcc", 2), ("ccb", 2)] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, seq string, label int, fold int")
    got = multiclass.fold_predictions(docs, [1, 2], learn.LearnConfig(maxpat=1, max_iterations=2, convergence=-1.0), 2)
    assert got.count() == 20 and got.where("label <> predicted").count() == 0
    assert {(r.fold, r.accuracy, r.n) for r in multiclass.fold_accuracy(got).collect()} == {(None, 1.0, 20), (0, 1.0, 10), (1, 1.0, 10)}


def vectors(spark, rows, sizes):
    rows_, names = baselines.vectorise(docs_of(spark, rows), sizes)
    x = np.array([[float(g in s.lower()) for g in names] for _, s, _ in rows])
    return rows_.select("y", "grams", "features"), names, x, np.array([y for _, _, y in rows])


def test_baselines_against_numpy(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 5))), rng.gauss(3, 4)) for i in range(80)]
    df, names, x, y = vectors(spark, rows, range(1, 3))
    df, names1, x1, _ = vectors(spark, rows, range(1, 2))
    n, a = len(y), np.c_[x1, np.ones(len(y))]
    ols = baselines.fit("ols", df, n)
    assert np.abs(np.r_[ols.coefficients.toArray(), ols.intercept] - np.linalg.lstsq(a, y, rcond=None)[0]).max() < 1e-3
    ridge = baselines.fit("ridge", df, n)
    want = np.linalg.solve(a.T @ a + np.diag([1.0] * x1.shape[1] + [0.0]), a.T @ y)
    assert np.abs(np.r_[ridge.coefficients.toArray(), ridge.intercept] - want).max() < 1e-3
    enet, w, b = baselines.fit("enet", df, n), np.zeros(x1.shape[1]), 0.0
    for _ in range(2000):  # coordinate descent
        b = (y - x1 @ w).mean()
        for j in range(len(w)):
            r = x1[:, j] @ (y - b - x1 @ w + x1[:, j] * w[j]) / n
            w[j] = np.sign(r) * max(0, abs(r) - 0.5) / ((x1[:, j] ** 2).sum() / n + 0.5)
    assert np.abs(np.r_[enet.coefficients.toArray(), enet.intercept] - np.r_[w, b]).max() < 1e-3
    got, gb = baselines.svr(baselines.sparse(df, names1), n, rounds=10, size=len(names1))
    w, b = np.zeros(x1.shape[1]), 0.0
    for t in range(1, 11):
        e = x1 @ w + b - y
        w, b = w * (1 - 1 / (n * t**0.5)) - x1.T @ np.sign(e) / (n * t**0.5), b - np.sign(e).sum() / (n * t**0.5)
    assert np.abs(np.r_[got, gb] - np.r_[w, b]).max() < 1e-9
    assert len(names) == x.shape[1] == len({g for _, s, _ in rows for k in (1, 2) for i in range(len(s) - k + 1) for g in [s.lower()[i : i + k]]})
    out = baselines.report("ols", ols.transform(df).withColumnRenamed("prediction", "score"), names1, ols.coefficients, {"fit": 0.5}).first()
    top = int(np.argmax(ols.coefficients.toArray()))
    assert (out.top_feature, out.fit_seconds) == (names1[top], 0.5) and abs(out.mse - ((a @ np.linalg.lstsq(a, y, rcond=None)[0] - y) ** 2).mean()) < 1e-4


def test_rows_that_share_an_id_have_scores_of_their_own(spark):
    docs = docs_of(spark, [(1, "th", 0.0), (1, "th", 0.0), (1, "x", 0.0), (None, "th", 0.0)])
    m = model.SequenceModel([(1.0, "th")])
    assert sorted(r.score for r in m.transform(docs).collect()) == [0.0, 1.0, 1.0, 1.0]
    many = model.with_matches(docs, m.rules(spark))
    assert sorted(len(r["__hits"]) for r in many.collect()) == [0, 1, 1, 1]


def test_masks_grow_within_the_limits():
    assert len(T.masks(60)) == 1 and len(T.masks(40, 1, 1)) == 39
    for size, total, run in ((5, 2, 1), (6, 3, 2), (4, 9, 9)):
        every = [m for m in itertools.product((False, True), repeat=size) if not m[0] and not m[-1] and sum(m) <= total and max(len(r) for r in "".join("*" if w else " " for w in m).split(" ")) <= run]
        assert T.masks(size, total, run) == sorted(every)


def test_places_of_rows_have_no_gaps(spark, tmp_path):
    spark.range(1000).repartition(7).sortWithinPartitions("id").selectExpr("id", "-id").write.csv(str(tmp_path / "m"))
    got = labelled.read_matrix(spark, str(tmp_path / "m"), 2)
    assert sorted(r.row for r in got.where("column = 1").collect()) == list(range(1000))
    assert got.groupBy("row").agg(F.sum("value").alias("s")).where("s <> 0").count() == 0


def test_truth_and_repair_of_toy_sequences(spark, tmp_path):
    planted = spark.createDataFrame([(0, "AB", 2.0), (1, "CD", -1.0)], "motif_id long, motif string, weight double")
    docs = generate.toy_sequences(spark, 60, 12, 4, planted, seed=1, noise=0.0, test_every=25, repair=True)
    rows = docs.collect()
    for r in rows:
        assert r.contains == [m for m in ("AB", "CD") if m in r.seq] and r.y == sum({"AB": 2.0, "CD": -1.0}[m] for m in r.contains)
    assert sum(r.test for r in rows) == 3 and len({tuple(r.contains) for r in rows}) == 4
    loose = generate.toy_sequences(spark, 60, 12, 4, planted, seed=1, noise=0.0)
    assert sum(len(r.contains) for r in rows) < sum(len(r.contains) for r in loose.collect())
    assert {len(r.seq) for r in generate.toy_sequences(spark, 30, 12, 4, planted, insert=True).collect()} == {12, 14, 16}
    sinks.write_truth(planted, docs, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t/correctModel")).collect()] == ["AB 2.0", "CD -1.0"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t/contains")).collect()) == sorted(" ".join(r.contains) for r in rows)


def test_sweeps(spark):
    config = learn.LearnConfig(maxpat=3, max_iterations=2, minsup=2)
    got = sweep.alphabet_sweep(spark, config, (2, 4), 1, 40, 12, 3, 1).collect()
    assert {(r.alphabet, r.run, r.method) for r in got} == {(k, 0, m) for k in (2, 4) for m in ("learned", "ridge")} and all(r.mse >= 0 for r in got)
    rows = [(i, g, k, s, y) for i, (g, k, s, y) in enumerate([(g, k, s, y) for g in ("t1", "t2") for k in ("HK", "ME") for s, y in (("aab", 3.0), ("abb", 2.0), ("bbb", 1.0))])]
    docs = spark.createDataFrame(rows, "doc_id long, group string, kind string, seq string, y double")
    out = sweep.transfer_sweep(docs, ("HK", "ME"), learn.LearnConfig(maxpat=2, max_iterations=4, convergence=-1.0)).collect()
    assert len(out) == 12 and all(abs(r.score - r.y) < 0.6 for r in out) and {r.trained_on for r in out} == {"HK", "ME"}


def test_search_of_no_documents_has_no_row(spark):
    from seqforge.plans import catalogue

    assert catalogue.best(spark, docs_of(spark, []), search.SearchConfig(maxpat=2)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from seqforge import session

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster())


def test_temporary_tables_go(spark):
    from seqforge.session import materialise, temporary

    with temporary(spark):
        with temporary(spark, keep="kept") as made:
            kept, gone = materialise(spark.range(3), "kept-x"), materialise(spark.range(3), "x")
            assert gone.count() == 3
        assert [os.path.exists(p.removeprefix("file://")) for p in made] == [True, False] and kept.count() == 3
    assert not any(os.path.exists(p.removeprefix("file://")) for p in made)


def test_line_search_finds_the_mean_for_squared_error(spark):
    rows = docs_of(spark, [(0, "a", 1.0), (1, "a", 2.0), (2, "a", 6.0)])
    state = learn.prepare(rows, False)
    assert abs(learn.line_search(state, "squared", -18.0, 3) - 3.0) < 1e-2


def test_penalty_changes_only_selected_features(spark):
    rows = [(0, "ab", 1.0), (1, "b", -1.0)]
    state = learn.prepare(docs_of(spark, rows), False).withColumn("g", F.col("y"))
    config = search.SearchConfig(c=1.0, alpha=0.5)
    level = search.penalised(search.rank_all(state, config, 1), {"a": 2.0}, config)
    got = {r.ngram: r.gradient for r in level.collect()}
    assert got["a"] == -1.0 + L.penalty_gradient(2.0, 1.0, 0.5) and got["b"] == 0.0


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y > 0], [s for s, y in pairs if y <= 0]
    if not pos or not neg:
        return 0.0
    return 100 * sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_auc50(pairs, most=50):
    pairs = sorted(pairs, reverse=True)
    total = sum(y > 0 for _, y in pairs)
    if not total or total == len(pairs):
        return 0.0
    area = x = y = 0.0
    breaks = [(0, 0)]
    for _, group in itertools.groupby(pairs, key=lambda p: p[0]):
        if x < most and (x, y) != breaks[-1]:
            area += (x - breaks[-1][0]) * (y + breaks[-1][1]) / 2
            breaks.append((x, y))
        for _, label in group:
            if label > 0:
                y += 1
            elif x < most:
                x += 1
    return 100 * (area + (x - breaks[-1][0]) * (total + breaks[-1][1]) / 2) / (most * total)


@pytest.mark.parametrize("seed", range(3))
def test_areas_and_threshold(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 12) / 4, rng.choice([-1.0, 1.0])) for _ in range(150)]
    scored = spark.createDataFrame(pairs, "score double, y double")
    assert abs(evaluate.auc(scored).first()[0] - brute_auc(pairs)) < 1e-9
    assert abs(evaluate.auc50(scored).first()[0] - brute_auc50(pairs)) < 1e-9
    cuts = sorted({s for s, _ in pairs})
    options = [float("-inf"), *((a + b) / 2 for a, b in itertools.pairwise(cuts)), cuts[-1] + 1]
    want = min((sum((y > 0) != (s > t) for s, y in pairs), t) for t in options)
    got = evaluate.tune(scored).first()
    assert (got.errors, got.threshold) == want


def test_area_of_one_class_is_zero(spark):
    scored = spark.createDataFrame([(0.5, 1.0), (0.1, 1.0)], "score double, y double")
    assert evaluate.auc(scored).first()[0] == 0.0
    known = spark.createDataFrame([(0.9, 1.0), (0.8, -1.0), (0.8, 1.0), (0.3, -1.0), (0.1, 1.0)], "score double, y double")
    assert abs(evaluate.auc(known).first()[0] - 58.333333333) < 1e-6


def test_running_sums_over_many_parts(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    got = {r.k: (r.before_v, r.previous) for r in evaluate.running(rows, "k", ["v"], descending=True).collect()}
    assert got == {i: (999 - i, i + 1 if i < 999 else None) for i in range(1000)}
    assert {r.k: r.previous for r in evaluate.running(rows, "k", ["v"]).collect()} == {i: i - 1 if i else None for i in range(1000)}


def test_shared_folder_is_cleared(spark):
    from seqforge.session import clear_shared, materialise, shared_dir

    materialise(spark.range(3), "x")
    clear_shared(spark)
    assert not os.path.exists(shared_dir(spark).removeprefix("file://") + "/seqforge")


def test_folds_are_stratified(spark):
    docs = spark.createDataFrame([(i, i % 3) for i in range(97)], "id long, label int")
    rows = evaluate.stratified_folds(docs, "id", "label").collect()
    for label in range(3):
        sizes = [sum(r.label == label and r.fold == k for r in rows) for k in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_planted_motif_is_recovered(spark):
    planted = spark.createDataFrame([(0, "ABDCA", 6.0)], "motif_id long, motif string, weight double")
    toy = generate.toy_sequences(spark, 150, 30, 4, planted, seed=3)
    again = generate.toy_sequences(spark, 150, 30, 4, planted, seed=3)
    assert toy.exceptAll(again).count() == 0
    got = learn.learn(toy, learn.LearnConfig(maxpat=5, max_iterations=2, minsup=3))
    row = generate.recovered(planted, got.model.rules(spark)).first()
    assert row.n_rules >= 1 and row.learned > 2


def test_model_files(spark, tmp_path):
    m = model.SequenceModel([(0.5, INTERCEPT), (-0.25, "nt"), (0.75, "nt")], bias=2.0)
    sinks.save_model(m, spark, str(tmp_path / "m"))
    back = sinks.open_model(spark, str(tmp_path / "m"))
    assert back.steps == m.steps and back.bias == 2.0 and sinks.open_model(spark, str(tmp_path / "m"), 0.5).bias == -0.5
    sinks.write_steps(m, spark, str(tmp_path / "s"))
    assert [(r.step, r.ngram) for r in labelled.read_steps(spark, str(tmp_path / "s")).orderBy("itr").collect()] == m.steps
    assert sinks.model_lines(m) == ["2", "0.5 INTERCEPT", "0.5 nt"]
    assert m.norms == (1.5, 0.5)


def test_hex_dumps(spark, tmp_path):
    (tmp_path / "a1.bytes").write_text("00401000 56 8D ?? 44\r\n00401010 0F\n")
    labels = spark.createDataFrame([("a1", 3), ("none", 4)], "Id string, Class int")
    assert [(r.Id, r.Class, r.seq) for r in labelled.read_hex_dumps(spark, str(tmp_path), labels).collect()] == [("a1", 3, "568D440F")]


def test_empty_inputs(spark):
    docs = docs_of(spark, [])
    assert labelled.centre(docs)[1] == 0.0
    assert learn.learn(docs, learn.LearnConfig(maxpat=2)).reason == "no gradient"
    assert evaluate.auc(spark.createDataFrame([], "score double, y double")).first()[0] == 0.0


def test_registered_queries_have_oracles():
    from seqforge.plans import catalogue

    free = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert free == {"baseline_report", "best_ngram_any_size", "toy_sequences", "motif_recovery", "ols_baseline", "ridge_baseline", "enet_baseline", "svr_baseline"}


# --- the kept tree ---------------------------------------------------------------------------------------------------


def made_rows(seed, n=40, letters="abc", size=9):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, size))), float(rng.choice([-1, 1])) * rng.choice([1.0, 0.5])) for i in range(n)]


def tree_of(spark, rows, config, **settings):
    return frontier.Frontier.of(docs_of(spark, rows), config, ["y"], **settings)


@pytest.mark.parametrize("seed,gaps,minsup,minpat,traversal", [(0, (0, 0), 1, 1, "bfs"), (1, (0, 0), 3, 2, "best"), (2, (1, 1), 1, 1, "dfs"), (3, (2, 1), 2, 1, "bfs"), (4, (0, 2), 1, 2, "best"), (5, (3, 0), 2, 1, "bfs")])
def test_kept_search_equals_brute_force(spark, monkeypatch, seed, gaps, minsup, minpat, traversal):
    monkeypatch.setattr(frontier, "BEAM", 3)
    rows = made_rows(seed)
    config = search.SearchConfig(maxpat=5, minsup=minsup, gaps=gaps, minpat=minpat, traversal=traversal)
    tree = tree_of(spark, rows, config)
    got = tree.search([("", 0)])["", 0]
    want = brute_best([(i, s, 2 * y) for i, s, y in rows], 5, minsup, gaps, minpat)
    assert (None if got is None else got.key) == want
    kept, widened = tree.counters.total, tree.counters.waves
    again = tree.search([("", 0)])["", 0]
    assert tree.trail == ({("", 0): [again]} if got else {})
    assert again.key == got.key and tree.counters.fresh == 0 and tree.counters.waves == 0 and tree.counters.kept == kept and widened > 0


def test_a_queue_that_is_too_small_loses_nothing(spark, monkeypatch):
    rows = made_rows(7, letters="abcd")
    config = search.SearchConfig(maxpat=4)
    want = tree_of(spark, rows, config).search([("", 0)])["", 0]
    monkeypatch.setattr(frontier, "QUEUE", 2)
    assert tree_of(spark, rows, config).search([("", 0)])["", 0] == want


def test_later_searches_read_no_text_and_best_first_expands_less(spark, monkeypatch):
    rows = made_rows(11, 80, "abcde", 14)
    counted = {}
    for order in ("bfs", "best"):
        monkeypatch.setattr(frontier, "BEAM", 2)
        tree = tree_of(spark, rows, search.SearchConfig(maxpat=6, minsup=2, traversal=order))
        counted[order] = tree.search([("", 0)])["", 0], tree.counters.expanded
    assert counted["bfs"][0] == counted["best"][0] and counted["best"][1] <= counted["bfs"][1]
    read = tree._sums(False, {})._jdf.queryExecution().executedPlan().toString()
    schema = read[read.index("FileScan parquet [") :].split("]")[0]
    assert "docs" in schema and not any(c in schema for c in ("codes", "places", "vocab"))


def test_learning_keeps_its_tree(spark):
    rows = [(i, s, y) for i, s, y in made_rows(13, 60, "abcd", 10) if s]
    out = learn.learn(docs_of(spark, rows), learn.LearnConfig(maxpat=3, max_iterations=4, convergence=-1.0))
    assert [(g, round(s, 6)) for s, g in out.model.steps] == brute_learn(rows, 4, 3)
    assert out.log[0]["kept"] == 0 and all(r["kept"] > 0 for r in out.log[1:])
    assert all(a["total"] == b["kept"] for a, b in zip(out.log, out.log[1:], strict=False))
    # what is added up over the moved documents equals what is computed anew
    f, steps = dict.fromkeys([i for i, _, _ in rows], 0.0), iter(out.model.steps)
    for row in out.log:
        delta, (step, gram) = next(steps)[0], next(steps)
        before = {i: v + delta for i, v in f.items()}
        f = {i: v + step * (gram in s) for (i, s, _), v in zip(rows, before.values(), strict=True)}
        assert abs(row["loss"] - sum((y - f[i]) ** 2 for i, _, y in rows)) < 1e-9
        assert abs(row["convRate"] - sum(abs(f[i] - before[i]) for i in f) / (1 + sum(map(abs, before.values())))) < 1e-9


@pytest.mark.parametrize("kind", ["squared", "logistic"])
def test_models_of_groups_and_responses_equal_single_ones(spark, kind):
    rows = [(i, s, y, "g" if i % 3 else "h", -y if s[:1] == "a" else y) for i, s, y in made_rows(17, 60)]
    rows = [(i, s, 1.0 if y > 0 else -1.0, g, 1.0 if z > 0 else -1.0) for i, s, y, g, z in rows]
    docs = spark.createDataFrame(rows, "doc_id long, seq string, y double, part string, z double")
    config = learn.LearnConfig(objective=kind, maxpat=2, max_iterations=2, convergence=-1.0, minsup=2, c=0.1)
    many = learn.learn_many(docs, config, ["y", "z"], "part")
    assert set(many) == {(g, r) for g in "gh" for r in (0, 1)}
    for (g, r), got in many.items():
        own = docs.where(F.col("part") == g).withColumn("y", F.col("yz"[r]))
        alone = learn.learn(own, config)
        assert [x for _, x in got.model.steps] == [x for _, x in alone.model.steps]
        assert np.allclose([s for s, _ in got.model.steps], [s for s, _ in alone.model.steps], atol=1e-3) and got.reason == alone.reason


def test_candidates_that_do_not_fit_prune_nothing(spark):
    rows = [(0, "abcd", 1.0), (1, "dcba", -1.0)]
    state = learn.prepare(docs_of(spark, rows), False).withColumn("g", F.col("y"))
    for candidates in (None, ["ab"], [f"a{T.WILD}c"], [f"a{T.WILD}"], [""]):
        got = search.best_ngram(state, search.SearchConfig(maxpat=1), candidates=candidates)
        assert got.ngram is None
        got = search.best_ngram(state, search.SearchConfig(maxpat=2, gaps=(0, 0)), candidates=candidates)
        assert got.ngram == "ab"
    assert learn.learn(docs_of(spark, rows), learn.LearnConfig(maxpat=2, max_iterations=1), candidates=["abc", "ab"]).model.steps[1][1] == "ab"


def test_bytes(spark):
    docs = docs_of(spark, [(0, "é", 1.0), (1, "è x", 1.0), (2, "x", -1.0), (3, None, -1.0), (4, "", -1.0)])
    found = tree_of(spark, [tuple(r) for r in docs.where("doc_id < 3").collect()], search.SearchConfig(maxpat=2, bytes=True)).search([("", 0)])["", 0]
    assert found.ngram.encode("latin-1") == b"\xc3" and found.support == 2
    m = model.SequenceModel([(1.0, "\xc3"), (0.5, "\xa9"), (0.25, "\xa8x"), (4.0, "\xe9")], bytes=True)
    assert {r.doc_id: r.score for r in m.transform(docs).collect()} == {0: 1.5, 1: 1.25, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {tuple(r.rules) for r in m.transform(docs, with_rules=True).collect()} == {("A9", "C3"), ("A878", "C3"), ()}


def test_blocks_hold_what_their_texts_hold():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé😀") for _ in range(rng.randint(0, 12))) for _ in range(30)]
    batch = pa.RecordBatch.from_pydict({"grp": ["g"] * 10 + ["h"] * 20, "bare": texts, "y0": [1.0] * 30, "f0": [0.0] * 30})
    rows = list(postings.index_texts(iter([batch]), 1, False, False))
    blocks = [b for r in rows for b in postings.blocks_of(r, r.schema.names)]
    assert [(b.grp, b.n) for b in blocks] == [("g", 10), ("h", 20)]
    for block, own in zip(blocks, (texts[:10], texts[10:]), strict=True):
        for _ in range(3):
            block = next(postings.blocks_of(postings.row_of(postings.extended(block, set(block.names.to_pylist()), 4, (2, 2), False)), rows[0].schema.names))
        names = block.names.to_pylist()
        want = {"".join(T.WILD if t is None else t for t in g) for s in own for n in range(1, 5) for m in T.masks(n, 2, 2) for g in grams(s, n, m)}
        assert sorted(names) == sorted(want)
        for k, g in enumerate(names):
            pattern = re.compile("(?s)" + "".join("." if t == T.WILD else re.escape(t) for t in g))
            assert block.docs[block.doc_starts[k] : block.doc_starts[k + 1]].tolist() == [i for i, s in enumerate(own) if pattern.search(s)]


def test_a_tree_has_one_table_of_small_row_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(frontier, "GROUP_BYTES", 1 << 10)
    tables = lambda: set(Path(session.shared_dir(spark).removeprefix("file://")).glob("seqforge/frontier-*"))
    others = tables()
    rows = made_rows(5, 8 * postings.DOCS, "abcde", 20)
    tree = frontier.Frontier.of(docs_of(spark, rows).coalesce(1), search.SearchConfig(maxpat=4), ["y"])
    tree.search([("", 0)])
    assert tree.counters.waves > 1
    (table,) = tables() - others
    assert all(pq.ParquetFile(f).num_row_groups > 5 for f in table.glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    tree.close()
    learn.learn(docs_of(spark, rows), learn.LearnConfig(objective="logistic", maxpat=2, max_iterations=1))
    assert tables() == others and "place" not in postings.SCHEMA


@pytest.mark.parametrize("seed,gaps,traversal,queue", [(0, (0, 0), "bfs", 20_000), (1, (0, 0), "best", 4), (2, (1, 1), "dfs", 3), (3, (2, 1), "bfs", 5), (4, (0, 2), "best", 20_000), (5, (0, 5), "bfs", 3)])
def test_a_tree_asked_once_writes_nothing_until_its_queue_overflows(spark, monkeypatch, seed, gaps, traversal, queue):
    rows, config = made_rows(40 + seed, 60, "abcd", 12), search.SearchConfig(maxpat=5, minsup=2, gaps=gaps, traversal=traversal)
    want = tree_of(spark, rows, config).search([("", 0)])["", 0]
    written, write = [], frontier.Frontier._written
    monkeypatch.setattr(frontier, "QUEUE", queue)
    monkeypatch.setattr(frontier, "BEAM", 3)
    monkeypatch.setattr(frontier.Frontier, "_written", lambda self, blocks: (written.append(1), write(self, blocks))[1])
    tree = tree_of(spark, rows, config, once=True)
    found = tree.search([("", 0)])["", 0]
    assert (found.ngram, found.support) == (want.ngram, want.support) and found.gradient == pytest.approx(want.gradient)
    assert tree.counters.waves and (len(written) == 1) == (queue == 20_000)
    with pytest.raises(ValueError):
        tree.search([("", 0)])


def test_a_task_adds_up_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(postings, "DOCS", 8)
    rows = made_rows(7, 100, "abc", 9)
    batch = pa.RecordBatch.from_pydict({"grp": [""] * 100, "bare": [t for _, t, _ in rows], "y0": [y for _, _, y in rows], "f0": [0.0] * 100})
    blocks = [b for r in postings.index_texts(iter([batch]), 1, False, False) for b in postings.blocks_of(r, r.schema.names)]
    sums = [postings.sums(postings.children_of(b, {"a": 1, "b": 1, "z": 1}, 3, (1, 1), False), "squared", True) for b in blocks]
    want = {}
    for x in sums:
        for r in x.to_pylist():
            own = want.setdefault(r["gram"], [r["size"], r["is_open"], 0, 0.0, 0.0])
            for i, c in enumerate(("support", "gradient0", "upos0"), 2):
                own[i] += r[c]
    for most in (1 << 18, 30):  # a task that holds all, and one that gives on what it has now and then
        monkeypatch.setattr(postings, "MERGE", most)
        out = [r for x in postings.merged(iter(sums)) for r in x.to_pylist()]
        assert (len(out) == len(want)) == (most > 30) and {r["gram"]: [r["size"], r["is_open"]] for r in out} == {g: w[:2] for g, w in want.items()}
        for i, c in enumerate(("support", "gradient0", "upos0"), 2):
            for g, w in want.items():
                assert sum(r[c] for r in out if r["gram"] == g) == pytest.approx(w[i])
    assert len(blocks) > 10 and not list(postings.merged(iter([])))


def test_children_by_table_and_by_bisection(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"grp": ["g"] * 40, "bare": texts, "y0": [1.0] * 40, "f0": [0.0] * 40})
    (block,) = (b for r in postings.index_texts(iter([batch]), 1, False, False) for b in postings.blocks_of(r, r.schema.names))
    grams = {"a": 1, "b" + T.WILD + "c": 3, "ca": 2, "zz": 2}
    out = []
    for walk, table in ((1 << 14, 1 << 22), (7, 0)):
        monkeypatch.setattr(postings, "WALK", walk)
        monkeypatch.setattr(postings, "TABLE", table)
        b = postings.planted(block, {"e": 1, "d" + T.WILD + "a": 3, "q": 1}, grams, 4, (2, 2), False)
        out.append({g: (size, b.docs[i:j].tolist()) for g, size, i, j in zip(b.names.to_pylist(), b.sizes.tolist(), b.doc_starts[:-1].tolist(), b.doc_starts[1:].tolist(), strict=True)})
    pattern = lambda g: re.compile(g.replace(T.WILD, "."))
    assert out[0] == out[1] and {"e", "d" + T.WILD + "a"} < out[0].keys() and len(out[0]) > 30
    assert all(size == len(g) and own == [i for i, s in enumerate(texts) if pattern(g).search(s)] for g, (size, own) in out[0].items())


@pytest.mark.parametrize("words", [False, True])
def test_counts_of_children(spark, words):
    docs = docs_of(spark, [(i, (" " if words else "").join(s), y) for i, s, y in made_rows(31, 40)] + [(99, None, 0.0)])
    found = {tuple(r) for r in frontier.child_counts(docs, words).select("ngram", "n", "support").collect()}
    want = {tuple(r) for r in index.occurrence_counts(index.children(index.first_level(docs, words), words), words).select("ngram", "n", "support").collect()}
    assert len(found) == 9 and found == want
    known = spark.createDataFrame([("a",)], "tok string")
    assert {r.ngram for r in frontier.child_counts(docs, words, known).collect()} == {g for g, _, _ in found if g.endswith("a")}


def test_a_large_model_is_one_walk(spark, monkeypatch):
    rng = random.Random(23)
    rules = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(50_000)})
    rules += [f"a{T.WILD}{T.WILD}b", f"c{T.WILD}d", "\U0001f600", ""]
    texts = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(20)] + ["", None, "zzz", "\U0001f600\U0001f600"]
    want = []
    for t in texts:
        held = {(t or "")[i : i + n] for n in range(1, 8) for i in range(len(t or ""))}
        own = [g for g in rules if g and (g in held if T.WILD not in g else re.search(g.replace(T.WILD, "."), t or ""))]
        want.append(sorted(own))
    for places in (1 << 18, 37):
        monkeypatch.setattr(matcher, "PLACES", places)
        tree = matcher.RuleTree([(g, 1.0) for g in rules])
        text, rule = tree.found(texts)
        got = [[tree.rules[k][0] for k in rule[text == i]] for i in range(len(texts))]
        assert got == want
    assert matcher.RuleTree([]).found(texts)[0].tolist() == []


@pytest.mark.parametrize("words", [False, True])
def test_a_walk_takes_windows_of_a_long_text(words, monkeypatch):
    sep, rng = " " if words else "", random.Random(37)
    rules = [sep.join(g) for g in ("abc", "cab", "aaaaaaa", f"b{T.WILD}{T.WILD}b", f"c{T.WILD}a", "zzzz", "b")]
    texts = ["", None, "abcab", "zzz", "c" * 9] + ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 5, 40, 300)]
    want = [[g for g in sorted(rules) if re.search(g.replace(" ", "").replace(T.WILD, "."), t or "")] for t in texts]
    for places in (1, 3, 7, 64, 1 << 16):
        monkeypatch.setattr(matcher, "PLACES", places)
        tree = matcher.RuleTree([(g, 1.0) for g in rules], words)
        text, rule = tree.found([t and sep.join(t) for t in texts])
        assert [[tree.rules[k][0] for k in rule[text == i]] for i in range(len(texts))] == want


def test_memory_of_a_walk_does_not_grow_with_a_batch():
    tree = matcher.RuleTree([(g, 1.0) for g in ("nt", "e", "th", f"e{T.WILD}h", "zzzzz")])
    peaks = []
    for n in (1, 4):
        for texts in (["the" * (n * 300_000)], ["the" * 3_000] * (n * 100)):
            tracemalloc.start()
            assert len(tree.found(texts)[0]) == 3 * len(texts)
            peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
            tracemalloc.stop()
    # windows of a fixed number of places: far less than the eight bytes of one number for each of 3,600,000 places
    assert max(peaks) < 20 and max(peaks[2:]) < 1.2 * max(peaks[:2]) + 1


def test_batches_are_taken_in_slices(spark, monkeypatch):
    monkeypatch.setattr(arrow, "SLICE_BYTES", 10)
    batch = pa.array(["abc", None, "", "abcdefgh", "x" * 50, None, "y", "z", ""])
    parts = list(arrow.slices(batch))
    assert pa.concat_arrays(parts).equals(batch) and [len(p) for p in parts] == [4, 1, 4]
    assert list(arrow.slices(batch.slice(0, 0))) == [] and pa.concat_arrays([*arrow.slices(batch.slice(3, 4))]).equals(batch.slice(3, 4))
    for kind in (pa.large_string(), pa.string()):
        assert len(list(arrow.slices(pa.nulls(5, kind)))) == 1
    monkeypatch.undo()
    most = arrow_rows(spark, 3000)
    assert most["rows"] == list(range(3000)) and most["bytes"] <= arrow.SLICE_BYTES + 1000


def arrow_rows(spark, n: int) -> dict:
    """The order of rows and the largest call of a function over texts of a thousand characters."""
    column = arrow.arrow_column(lambda: lambda texts: pa.array([sum(map(len, texts.to_pylist()))] * len(texts), pa.int64()), "bigint", F.col("t"))
    rows = spark.range(0, n, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("t")).select("id", column.alias("b")).collect()
    return {"rows": [r.id for r in rows], "bytes": max(r.b for r in rows)}


def test_literal_rules_need_no_python_worker(spark):
    rules = X.rules_frame(spark, X.WILD_RULES)
    assert [tuple(r) for r in rules.collect()] == [(g.replace("*", T.WILD), w) for g, w in X.WILD_RULES]
    assert rules.dtypes == [("ngram", "string"), ("weight", "double")] and "RDD" not in rules._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_summed_where_rules_are_found(spark):
    rng = random.Random(41)
    rules = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))): rng.uniform(-1, 1) for _ in range(3000)}.items())
    rows = [(i, "".join(rng.choice("abcd") for _ in range(500)), 0.0) for i in range(40)] + [(40, "", 0.0), (40, None, 0.0), (None, "ab", 0.0)]
    docs = docs_of(spark, rows)
    out = model.score(docs, rules, -0.3)
    named = model.score(docs, rules, -0.3, with_rules=True)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.seq or "", r.score)
    got, want = ([(r.doc_id, r.seq, r.score, r.probability, r.n_rules) for r in sorted(x.collect(), key=key)] for x in (out, named))
    assert got == want and sum(r[4] for r in got) > 10_000
    assert out.dtypes == named.drop("rules").dtypes
    # arrays of a document's rules leave the task only where they are asked for
    assert ["aggregate(" in x._jdf.queryExecution().executedPlan().toString() for x in (out, named)] == [False, True]


def test_tasks_get_a_tree_as_arrays():
    rules = [(f"{i:05d}", i / 7) for i in range(20_000)]
    for words in (False, True):
        tree = matcher.RuleTree(rules, words)
        back = pickle.loads(pickle.dumps(tree))
        assert back.rules is None and back.weights.tolist() == [w for _, w in tree.rules] and back.names.to_pylist() == [g for g, _ in tree.rules]
        assert [x.tolist() for x in back.found(["00017 x", None, "19999"])] == [x.tolist() for x in tree.found(["00017 x", None, "19999"])]


def test_reasons_and_trails(spark):
    rows = made_rows(29, 30)
    out = learn.learn(docs_of(spark, rows), learn.LearnConfig(minsup=1000, max_iterations=3))
    assert out.reason == "no token has enough support" and [g for _, g in out.model.steps] == [INTERCEPT]
    tree = tree_of(spark, rows, search.SearchConfig(maxpat=4))
    best = tree.search([("", 0)])["", 0]
    trail = [w.key for w in tree.trail["", 0]]
    assert trail == sorted(trail, reverse=True) and trail[-1] == best.key


def test_saved_models_without_steps_and_tuned_ones(spark, tmp_path):
    sinks.save_model(model.SequenceModel(bias=2.5, words=True, gaps=(3, 1)), spark, str(tmp_path / "empty"))
    back = sinks.open_model(spark, str(tmp_path / "empty"))
    assert (back.steps, back.bias, back.words, back.gaps) == ([], 2.5, True, (3, 1))
    docs = docs_of(spark, [(0, "a", 1.0), (1, "ab", -1.0), (2, "b", -1.0), (3, "aa", 1.0)])
    m = model.SequenceModel([(1.0, "a"), (-0.5, "b")], bias=9.0)
    threshold, errors = m.tune(docs)
    assert (threshold, errors, m.bias) == (0.75, 0, -0.75)
    assert evaluate.counts(m.transform(docs)).first().asDict() == {"tp": 2, "fp": 0, "fn": 0, "tn": 2}


def test_predictions_need_their_columns(spark):
    scored = model.SequenceModel([(1.0, "a")]).transform(docs_of(spark, [(0, "a", 1.0)]))
    for verbosity in (3, 4, 5):
        with pytest.raises(ValueError):
            sinks.predictions(scored, verbosity)
    assert sinks.predictions(scored, 2).count() == 1


def test_baselines_meet_their_conditions(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))), rng.gauss(0, 3)) for i in range(90)]
    df, names = baselines.vectorise(docs_of(spark, rows), range(1, 2))
    for kind in ("ols", "ridge", "enet"):
        fitted = baselines.fit(kind, df, 90)
        found = baselines.optimality(kind, fitted, df, names, 90).collect()
        assert {r.ngram for r in found} == {*names, INTERCEPT} and all(r.gap < 1e-4 for r in found)
        assert {r.ngram: r.support for r in found} == {g: sum(g in s for _, s, _ in rows) for g in names} | {INTERCEPT: 90}


def test_baseline_conditions_hold_the_features_of_the_baselines(spark, tmp_path):
    from seqforge.plans import catalogue

    rng = random.Random(18)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, rng.randint(0, 1)) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = catalogue.queries()["baseline_conditions"](spark, str(tmp_path)).collect()
    bare = [b for t in texts if (b := t.replace(" ", ""))]
    want = {g: sum(g in b for b in bare) for b in bare for n in (1, 2, 3) for g in (b[i : i + n] for i in range(len(b) - n + 1))} | {INTERCEPT: len(bare)}
    assert {(r.kind, r.ngram, r.support) for r in found} == {(k, g, c) for k in ("ols", "ridge", "enet") for g, c in want.items()} and len(found) == 3 * len(want)
    assert all(r.gap == 0.0 for r in found)


@pytest.mark.parametrize("normal", [4096, 0])
def test_baselines_are_fitted_until_they_converge(spark, monkeypatch, normal):
    monkeypatch.setattr(baselines, "NORMAL", normal)
    rng = random.Random(28)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 60))), rng.gauss(0, 30)) for i in range(120)]
    df, names = baselines.vectorise(docs_of(spark, rows), range(1, 4))
    for kind in ("ols", "ridge", "enet"):
        fitted = baselines.fit(kind, df, 120)
        assert max(r.gap for r in baselines.optimality(kind, fitted, df, names, 120).collect()) < 5e-3 * (kind == "ols") + 5e-4
        assert (kind != "enet") or any(fitted.coefficients)


# --- labelled lines as a stream --------------------------------------------------------------------------------------

LINES = ["1 abc", "; comment", "", "-2\tb\r", "noDelim", "3 ", "1 é\U0001f600", "0.5 last"]


def streamed(spark, folder, out, state, **options):
    rows = stream.read_labelled_stream(spark, folder, **options).select("place", "y", "seq", "malformed")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.place, r.y, r.seq, r.malformed) for r in spark.read.schema("place long, y double, seq string, malformed boolean").parquet(out).collect())


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("lines", "out", "state"))
    stream.spool(LINES[:3], folder)
    first = streamed(spark, folder, out, state)
    stream.spool(LINES[3:], folder, at_once=2)
    with open(f"{folder}/lines.txt", "a") as f:
        f.write("9 half a li")  # no end yet
    every = streamed(spark, folder, out, state)
    want = sorted((r.y, r.seq, r.malformed) for r in labelled.read_labelled(spark, f"{folder}/lines.txt").collect() if r.seq != "half a li")
    assert [x[1:] for x in first] == [(1.0, "abc", False)] and sorted(x[1:] for x in every) == want and len(want) == 5
    with open(f"{folder}/lines.txt", "a") as f:
        f.write("ne\n")
    assert sorted(x[1:] for x in streamed(spark, folder, out, state)) == sorted([*want, (9.0, "half a line", False)])


def test_the_limit_of_a_stream_is_never_passed(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("lines", "out", "state"))
    stream.spool(LINES[:4], folder)
    assert len(streamed(spark, folder, out, state, limit=3)) == 2
    stream.spool(LINES[4:], folder)
    assert [x[2] for x in streamed(spark, folder, out, state, limit=3)] == ["abc", "b", "noDelim"]


def test_ranges_share_out_the_lines(tmp_path, monkeypatch):
    path = tmp_path / "x.txt"
    path.write_bytes(b"a\n\nbcd\nef\n" + b"g" * 50 + b"\nlast")
    system, size = stream.opened(str(path))[0], path.stat().st_size
    whole = list(stream.lines_of(system, str(path), 0, size))
    assert [x for _, x in whole] == [b"a", b"", b"bcd", b"ef", b"g" * 50, b"last"]
    for chunk, width in ((1 << 20, 1), (3, 2), (5, 7), (1, 100)):
        monkeypatch.setattr(stream, "CHUNK", chunk)
        assert [x for i in range(0, size, width) for x in stream.lines_of(system, str(path), i, min(i + width, size))] == whole
        assert stream.last_line_end(system, str(path), size, 0) == size - 4
    assert [stream.accepted(x.encode()) for x in LINES] == [True, False, False, True, True, False, True, True]


def test_scores_of_a_stream_of_lines(spark, tmp_path):
    folder, out = str(tmp_path / "lines"), str(tmp_path / "scored")
    stream.spool(LINES, folder)
    m = model.SequenceModel([(1.0, "b"), (0.5, "\U0001f600")], bias=0.25)
    scoring.start(stream.read_labelled_stream(spark, folder), m, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.score for r in spark.read.parquet(out).collect()) == [0.25, 0.25, 0.75, 1.25, 1.25]


def test_a_file_of_lines_is_written_by_many_tasks(spark, tmp_path):
    from seqforge.plans import catalogue

    spark.createDataFrame([(i, f"text {'ab' * i}", "en") for i in range(400)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = Path(catalogue._line_file(spark, str(tmp_path)).removeprefix("file://"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(path.glob("part-*"))
    assert len(files) > 1  # in the order of their names the lines go on by doc_id
    lengths = [len(x) for f in files for x in f.read_text().split("\n") if x.startswith("text")]
    assert lengths == sorted(lengths)


def test_ngrams_are_found_once_and_no_batch_is_large(spark):
    from seqforge.functions.arrow import BATCH_ROWS

    texts = ["", "a", "abab", "É\U0001f600b", None, "ba" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "seq string").select("seq", baselines.distinct_grams(F.col("seq"), range(1, 4)).alias("g")).collect()
    for r in got:
        assert (r.g is None) == (r.seq is None)
        want = {r.seq[i : i + n] for n in (1, 2, 3) for i in range(len(r.seq) - n + 1)} if r.seq else set()
        assert len(r.g or []) == len(want) and set(r.g or []) == want
    rows, names = baselines.vectorise(docs_of(spark, [(0, "ab", 1.0), (1, "B", 2.0)]), range(1, 3))
    assert names == ["b", "a", "ab"] and "regexp" not in rows._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    baselines.sparse(rows.select("grams", "y"), names).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS)
