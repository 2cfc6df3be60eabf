"""Greedy coordinate descent over all n-grams, for one model or for many at once.

A learning run is a loop on the driver over Spark jobs; what it keeps there is one number or row for each step and model. All
models, that is responses and groups of the documents, go through the same jobs: each iteration sums losses and residuals once, searches one
kept tree (:mod:`seqforge.operators.frontier`) for every model's best n-gram, and sums the changes over the documents that hold
one of them. Scores are a column of the tree's rows; after ``FOLD`` iterations without an extension the rows are written anew, which ends their lineage.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import loss as L
from seqforge.functions import text as T
from seqforge.operators.frontier import Frontier, Model, of_group
from seqforge.operators.model import INTERCEPT, SequenceModel
from seqforge.operators.search import SearchConfig, least_gradient
from seqforge.session import materialise, temporary
from seqforge.sources.labelled import LOG_SCHEMA

#: Iterations after which scores are written, and parts of a line search's grid.
FOLD, GRID = 5, 32


@dataclass
class LearnConfig(SearchConfig):
    """Search settings and those of the loop. ``validation``: stop where the validation loss rises above the ``initial`` or
    the ``previous`` one; ``tolerance`` of a line search, over all documents that it moves."""

    convergence: float = 0.005
    max_iterations: int = 5000
    validation: str = "initial"
    tolerance: float = 1e-3


@dataclass
class Learned:
    model: SequenceModel
    log: list[dict] = field(default_factory=list)
    reason: str = ""


def prepare(docs: DataFrame, words: bool, f: Column | float = 0.0, as_bytes: bool = False) -> DataFrame:
    """doc_id, y, toks, bare (the text in which rules are looked for) and f, written once."""
    seq = T.symbols(F.col("seq"), as_bytes)
    return materialise(docs.select("doc_id", F.col("y").cast("double").alias("y"), T.tokens(seq, words).alias("toks"), T.bare(seq, words).alias("bare"), (F.lit(f) if isinstance(f, float) else f).alias("f")), "documents")


def total_loss(state: DataFrame, kind: str) -> float:
    return state.agg(F.sum(L.loss(kind, F.col("y"), F.col("f")))).first()[0] or 0.0


#: A step's penalty.
Penalty = Callable[[float], float]


def losses_at(rows: DataFrame, kind: str, steps: dict[str, list[float]]) -> dict[str, list[float]]:
    """The loss of each group (grp) of ``rows`` (y, f) after each of its steps, in one job."""
    # a row for each model and step; steps that come as data leave the plan's code as it is in every round
    cells = [(g, i, float(x)) for g, own in steps.items() for i, x in enumerate(own)]
    table = rows.sparkSession.createDataFrame(pa.table(dict(zip(("grp", "i", "step"), map(pa.array, zip(*cells, strict=True)), strict=True))))
    found = rows.join(F.broadcast(table), "grp").groupBy("grp", "i").agg(F.sum(L.loss(kind, F.col("y"), F.col("f") + F.col("step"))).alias("loss")).collect()
    out = {g: [0.0] * len(own) for g, own in steps.items()}
    for r in found:
        out[r["grp"]][r["i"]] = r["loss"] or 0.0
    return out


def line_searches(rows: DataFrame, kind: str, gradients: dict[str, tuple[float, int]], penalties: dict[str, Penalty] | None = None, tolerance: float = 1e-3) -> dict[str, float]:
    """For each group of ``rows`` (grp, y, f) the step against its gradient (with the documents' number): steps that double until the regularised
    loss no longer falls, then ever finer grids around the best of them, until the step is known to ``tolerance`` over all
    documents. The groups share the jobs."""
    none = lambda step: 0.0
    penalty = {g: (penalties or {}).get(g, none) for g in gradients}
    first: dict[str, list[float]] = {}
    for grp, (gradient, n) in gradients.items():
        if gradient and n:
            epsilon = min(1e-3, 10.0 ** -math.ceil(math.log10(abs(gradient))) if abs(gradient) > 1 else 1e-3)
            first[grp] = [0.0, *(-epsilon * gradient * 2.0**k for k in range(40))]
    out = dict.fromkeys(gradients, 0.0)
    if not first:
        return out
    ends: dict[str, tuple[float, float]] = {}
    for grp, losses in losses_at(rows, kind, first).items():
        steps = first[grp]
        found = [v + penalty[grp](s) for v, s in zip(losses, steps, strict=True)]
        k = 1
        while k + 1 < len(steps) and found[k + 1] < found[k]:
            k += 1
        ends[grp] = steps[k - 1], steps[min(k + 1, len(steps) - 1)]
    going = set(ends)
    while going := {g for g in going if gradients[g][1] * abs(ends[g][1] - ends[g][0]) > tolerance}:
        grids = {g: [ends[g][0] + (ends[g][1] - ends[g][0]) * i / GRID for i in range(GRID + 1)] for g in sorted(going)}
        for grp, losses in losses_at(rows, kind, grids).items():
            grid = grids[grp]
            values = [v + penalty[grp](s) for v, s in zip(losses, grid, strict=True)]
            i = min(range(GRID + 1), key=values.__getitem__)
            new = grid[max(0, i - 1)], grid[min(GRID, i + 1)]
            if abs(new[1] - new[0]) >= abs(ends[grp][1] - ends[grp][0]):
                going.discard(grp)
            else:
                ends[grp] = new
    return out | {g: (low + high) / 2 for g, (low, high) in ends.items()}


def line_search(rows: DataFrame, kind: str, gradient: float, support: int, penalty: Penalty = lambda step: 0.0, tolerance: float = 1e-3) -> float:
    """:func:`line_searches` of one model's documents ``rows`` (y, f)."""
    return line_searches(rows.withColumn("grp", F.lit("")), kind, {"": (gradient, support)}, {"": penalty}, tolerance)[""]


def intercept_step(state: DataFrame, kind: str, tolerance: float = 1e-3) -> float:
    """Squared error: the mean residual; else by line search."""
    if kind == "squared":
        return state.agg(F.avg(F.col("y") - F.col("f"))).first()[0] or 0.0
    gradient, n = state.agg(-F.sum(L.pull(kind, F.col("y"), F.col("f"))), F.count("*")).first()
    return line_search(state, kind, gradient or 0.0, n, tolerance=tolerance)


@dataclass
class Totals:
    """Of one model's documents: their number, residuals, losses, absolute scores, and the intercept's gradient."""

    n: int
    residual: float
    loss: float
    size: float
    gradient: float


class Run:
    """The state of a learning run of many models over one kept tree."""

    def __init__(self, tree: Frontier, config: LearnConfig, biases: dict[Model, float] | None = None):
        self.tree, self.config, self.kind = tree, config, config.objective
        self.totals = self.sums()
        new = lambda m: SequenceModel(bias=(biases or {}).get(m, 0.0), words=config.words, gaps=config.gaps, bytes=config.bytes)
        self.learned: dict[Model, Learned] = {m: Learned(new(m)) for m in sorted(self.totals)}
        self.active: list[Model] = list(self.learned)
        self.regular = {m: t.loss for m, t in self.totals.items()}
        self.unfolded = 0

    def sums(self) -> dict[Model, Totals]:
        """One pass over all documents: each model's sums."""
        columns = []
        for r in range(self.tree.responses):
            y, f = F.col(f"y{r}"), F.col(f"f{r}")
            columns += [F.sum(y - f).alias(f"residual{r}"), F.sum(L.loss(self.kind, y, f)).alias(f"loss{r}"), F.sum(F.abs(f)).alias(f"size{r}"), (-F.sum(L.pull(self.kind, y, f))).alias(f"gradient{r}")]
        rows = self.tree.documents().groupBy("grp").agg(F.count("*").alias("n"), *columns).collect()
        names = ("residual", "loss", "size", "gradient")
        return {(x["grp"], r): Totals(x["n"], *(x[f"{c}{r}"] or 0.0 for c in names)) for x in rows for r in range(self.tree.responses)}

    def of_response(self, r: int, models: list[Model] | None = None) -> list[Model]:
        return [m for m in (self.active if models is None else models) if m[1] == r]

    def rows_of(self, r: int, wanted: dict[str, str] | None = None) -> DataFrame:
        rows = self.tree.documents() if wanted is None else self.tree.documents({r: wanted}).where(f"h{r}")
        return rows.select("grp", F.col(f"y{r}").alias("y"), F.col(f"f{r}").alias("f"))

    def stop(self, m: Model, reason: str) -> None:
        self.learned[m].reason = reason
        self.active.remove(m)

    def intercepts(self) -> dict[Model, float]:
        if self.kind == "squared":
            return {m: self.totals[m].residual / self.totals[m].n for m in self.active}
        out = {}
        for r in range(self.tree.responses):
            gradients = {m[0]: (self.totals[m].gradient, self.totals[m].n) for m in self.of_response(r)}
            if gradients:
                with temporary(self.tree.rows.sparkSession):
                    out |= {(g, r): s for g, s in line_searches(materialise(self.rows_of(r), "scores"), self.kind, gradients, tolerance=self.config.tolerance).items()}
        return out

    def steps(self, found: dict) -> dict[Model, tuple[float, float, float]]:
        """For each model its step, the loss that it takes off, and the change of all scores, over the documents that it moves."""
        config, out = self.config, {}
        wanted = {r: {m[0]: found[m].ngram for m in self.of_response(r, list(found))} for r in range(self.tree.responses)}
        wanted = {r: w for r, w in wanted.items() if w}
        if self.kind == "squared":
            sums = []
            for r in wanted:
                residual = F.when(F.col(f"h{r}"), F.col(f"y{r}") - F.col(f"f{r}"))
                sums += [F.count(residual).alias(f"n{r}"), F.sum(residual).alias(f"sum{r}")]
            moved = self.tree.documents(wanted).where(" or ".join(f"h{r}" for r in wanted))
            rows = {x["grp"]: x for x in moved.groupBy("grp").agg(*sums).collect()}
            for m in found:
                n, total = rows[m[0]][f"n{m[1]}"], rows[m[0]][f"sum{m[1]}"]
                step = total / n
                out[m] = step, -step * total, n * abs(step)
            return out
        for r in wanted:
            gradients, penalties = {}, {}
            for g in wanted[r]:
                weight = self.learned[g, r].model.weights.get(found[g, r].ngram, 0.0)
                gradients[g] = (found[g, r].gradient, found[g, r].support)
                penalties[g] = lambda s, w=weight: L.penalty([w + s], config.c, config.alpha) - L.penalty([w], config.c, config.alpha)
            with temporary(self.tree.rows.sparkSession):
                moved = materialise(self.rows_of(r, wanted[r]), "scores")
                steps = line_searches(moved, self.kind, gradients, penalties, config.tolerance)
                change = L.loss(self.kind, F.col("y"), F.col("f") + of_group(steps)) - L.loss(self.kind, F.col("y"), F.col("f"))
                for x in moved.groupBy("grp").agg(F.sum(change).alias("change"), F.count("*").alias("n")).collect():
                    if x["grp"] in steps:
                        out[x["grp"], r] = steps[x["grp"]], x["change"], x["n"] * abs(steps[x["grp"]])
        return out

    def iterate(self, itr: int, floors: dict[Model, float]) -> None:
        """One step of every active model."""
        config, tree = self.config, self.tree
        deltas = self.intercepts()
        for r in range(tree.responses):
            tree.shift(r, {m[0]: deltas[m] for m in self.of_response(r)})
        for m, delta in deltas.items():
            self.learned[m].model.add(delta, INTERCEPT)
        shifted = self.sums()
        winners = tree.search(self.active, {m: self.learned[m].model.weights for m in self.active}, floors)
        for m in [m for m in self.active if winners[m] is None]:
            self.stop(m, "no gradient" if tree.counters.total else "no token has enough support")
        found = {m: winners[m] for m in self.active}
        steps = self.steps(found) if found else {}
        taken: dict[Model, float] = {}
        for m, (step, change, moved) in steps.items():
            out, winner, before = self.learned[m], found[m], shifted[m]
            weights = out.model.weights
            weights[winner.ngram] = weights.get(winner.ngram, 0.0) + step
            loss = before.loss + change
            reg = loss + L.penalty(weights.values(), config.c, config.alpha)
            rate = moved / (1 + before.size)
            counted = tree.counters
            row = {"Iteration": itr + 1, "#Features": len(weights), "#rewritten": counted.rewritten, "#pruned": counted.total - counted.expanded, "total": counted.total, "optimalStepLength": step, "symbol": winner.ngram.replace(T.WILD, "*"), "support": winner.support, "loss": loss, "regLoss": reg, "convRate": rate, "kept": counted.kept, "fresh": counted.fresh, "expanded": counted.expanded, "waves": counted.waves}
            if reg == self.regular[m]:
                self.stop(m, "loss unchanged")
                continue
            if abs(step) <= 1e-8:
                self.stop(m, "no step")
                continue
            out.model.add(step, winner.ngram)
            out.log.append(row)
            self.regular[m], taken[m] = reg, step
            residual = before.residual - step * winner.support
            self.totals[m] = Totals(before.n, residual, loss, before.size, before.gradient)
            if rate <= config.convergence:
                self.stop(m, "converged")
        for r in range(tree.responses):
            moving = self.of_response(r, list(taken))
            tree.shift(r, {m[0]: taken[m] for m in moving}, {m[0]: found[m].ngram for m in moving})
        self.unfolded = self.unfolded + 1 if not tree.counters.waves else 0
        if self.unfolded == FOLD:
            tree.fold()
            self.unfolded = 0
        if self.kind != "squared" and self.active:
            self.totals = self.sums()


def learn_many(docs: DataFrame, config: LearnConfig, responses: list[str] | None = None, group: str | None = None, biases: dict[Model, float] | None = None) -> dict[Model, Learned]:
    """A model for each of ``responses`` (columns of ``docs``) in each group, in the jobs of one: (group, number of the response) to what
    was learned. The group is a string, that of null is a zero character; without ``group`` it is empty."""
    run = Run(Frontier.of(docs, config, responses or ["y"], group), config, biases)
    for itr in range(config.max_iterations):
        if not run.active:
            break
        run.iterate(itr, {})
    for m in list(run.active):
        run.stop(m, "iterations")
    run.tree.close()
    return run.learned


def learn(docs: DataFrame, config: LearnConfig, validation: DataFrame | None = None, bias: float = 0.0, candidates: list[str] | None = None) -> Learned:
    """Fit a model to ``docs`` (doc_id, seq, y), or to a table that :func:`prepare` has made of them. ``candidates``: n-grams, as
    of a former run's rules, of which the best prunes the first search (a warm start; the result is the same)."""
    docs = docs.withColumn("f0", F.col("f")) if "f" in docs.columns else docs
    only: Model = ("", 0)
    run = Run(Frontier.of(docs, config, ["y"]), config, {only: bias})
    if not run.learned:  # no documents
        run.tree.close()
        out = Learned(SequenceModel(bias=bias, words=config.words, gaps=config.gaps, bytes=config.bytes), reason="no gradient")
        out.model.add(0.0, INTERCEPT)
        return out
    out, checked = run.learned[only], None
    for itr in range(config.max_iterations):
        floors = {}
        if itr == 0 and candidates:
            floors = {only: warm_start(run, docs, candidates)}
        run.iterate(itr, floors)
        if not run.active:
            break
        if validation is not None and itr % 5 == 0:
            now = validation_loss(out.model, validation)
            if checked is not None and now > checked:
                run.stop(only, "validation loss")
                break
            if checked is None or config.validation == "previous":
                checked = now
    else:
        out.reason = "iterations"
    run.tree.close()
    return out


def warm_start(run: Run, docs: DataFrame, candidates: list[str]) -> float:
    """The gradient that the best of some n-grams will have once the intercept is in."""
    delta = run.intercepts()["", 0]
    f = (F.col("f0") if "f0" in docs.columns else F.lit(0.0)) + F.lit(delta)
    pull = L.pull(run.kind, F.col("y").cast("double"), f)
    return least_gradient(docs.select(T.bare(T.symbols(F.col("seq"), run.config.bytes), run.config.words).alias("bare") if "bare" not in docs.columns else "bare", pull.alias("g")), run.config, {}, candidates)


def validation_loss(model: SequenceModel, validation: DataFrame) -> float:
    """Squared error on held-out documents, for any objective."""
    scored = model.transform(validation)
    return scored.agg(F.sum((F.col("y") - F.col("score")) * (F.col("y") - F.col("score")))).first()[0] or 0.0


def log_frame(spark, log: list[dict]) -> DataFrame:
    """The iteration log as a table (a row for each step)."""
    names = [c.split()[0].strip("`") for c in LOG_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in log], LOG_SCHEMA)
