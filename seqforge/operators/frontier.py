"""A search tree that is kept between iterations and shared by many models.

A model is a response of a group: ``y0``, ``y1``, ... are the responses of each document (the classes of one-vs-rest learning), ``grp``
its group (each group has models of its own). Blocks of documents (:mod:`seqforge.operators.postings`) hold the documents of
every n-gram found so far; the table of these blocks is written to the shared folder, grows by extension alone, and takes the place of the
one before:

* The gradients of all n-grams for all models come from one aggregation over the blocks' postings, of partial sums: no text is
  read, and no n-gram is made again. A later iteration needs nothing else, unless an open n-gram's bound exceeds what has been found.
* An n-gram is extended from its places, which are found in the block's tokens: by the next token, and by up to a run of wildcards and the
  token behind them. A document's tokens stay in its block, so this needs no join. Masks of wildcards are never enumerated.
* For each model an n-gram is extended only if the gradient that any extension can have exceeds the model's best, or
  equals it where an extension may still come first. An n-gram is extended if one model asks for it.

The driver holds a bounded queue of open n-grams in the order of ``traversal``: level by level (``bfs``, up to ``WAVE`` at once), by the
largest bound (``best``) or the deepest first (``dfs``), up to ``BEAM`` at once. What does not fit the queue is found by another
aggregation when the queue is empty. Winners do not depend on the order.

A tree that is asked ``once`` keeps nothing of its extensions as long as the driver's queue holds every open n-gram that may still count: a wave is one job,
in which blocks find the children in their tokens and give the sums of these. If the queue overflows, the open n-grams are written
and the search goes on as above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.functions import loss as L
from seqforge.functions import text as T
from seqforge.functions.arrow import bound_batches
from seqforge.operators import postings
from seqforge.operators.search import SearchConfig
from seqforge.session import delete, fresh_path, ship_package

#: A group and the number of a response.
Model = tuple[str, int]

#: N-grams that are extended at once, level by level and by the other orders, and n-grams that the driver queues.
WAVE, BEAM, QUEUE = 4_000, 256, 20_000
#: Bytes of a row group of blocks: what a reader holds of them at once.
GROUP_BYTES = 16 << 20


@dataclass
class Winner:
    ngram: str
    size: int
    gradient: float
    support: int

    @property
    def key(self) -> tuple[float, int, str]:
        return -round(abs(self.gradient), 9), self.size, self.ngram


@dataclass
class Node:
    """An open n-gram with the bound of each response."""

    grp: str
    gram: str
    size: int
    reach: list[float]


@dataclass
class Counters:
    """N-grams whose gradients were summed from the kept table and after extensions, those extended, those whose bound a penalty
    changed, and the extensions' waves, in one search."""

    kept: int = 0
    fresh: int = 0
    expanded: int = 0
    rewritten: int = 0
    waves: int = 0

    @property
    def total(self) -> int:
        return self.kept + self.fresh


@dataclass
class Look:
    """Open n-grams, and of all n-grams the number, and that of those whose bound a penalty changed."""

    nodes: list[Node]
    n: int
    rewritten: int

    @property
    def full(self) -> bool:
        return len(self.nodes) >= QUEUE


@dataclass
class Frontier:
    """``rows``: blocks. ``moves``: what was learned since they were written."""

    rows: DataFrame
    config: SearchConfig
    responses: int = 1
    #: Where the rows are written.
    path: str = ""
    #: There will be a single search.
    once: bool = False
    counters: Counters = field(default_factory=Counters)
    begun: bool = False
    moves: list[postings.Move] = field(default_factory=list)
    #: Of the last search, the best n-grams of each model in the order in which they replaced one another.
    trail: dict[Model, list[Winner]] = field(default_factory=dict)

    @classmethod
    def of(cls, docs: DataFrame, config: SearchConfig, responses: list[str], group: str | None = None, once: bool = False) -> Frontier:
        """The tree of single tokens over ``docs`` (seq or bare, responses, group; f<r> where it isn't 0)."""
        ship_package(docs.sparkSession)
        bound_batches(docs.sparkSession)
        bare = F.col("bare") if "bare" in docs.columns else T.bare(T.symbols(F.col("seq"), config.bytes), config.words)
        grp = F.lit("") if group is None else F.coalesce(F.col(group).cast("string"), F.lit("\0"))
        ys = [F.col(y).cast("double").alias(f"y{r}") for r, y in enumerate(responses)]
        fs = [(F.col(f"f{r}") if f"f{r}" in docs.columns else F.lit(0.0)).alias(f"f{r}") for r in range(len(responses))]
        rows = docs.select(grp.alias("grp"), *ys, *fs, bare.alias("bare"))
        rows = rows if group is None else rows.sortWithinPartitions("grp")
        n, only, words = len(responses), config.maxpat == 1, config.words
        blocks = rows.mapInArrow(lambda batches: postings.index_texts(batches, n, only, words), postings.SCHEMA)
        out = cls(blocks, config, n, once=once)
        out._written(blocks)
        return out

    def blocks(self, kernel: Callable[[postings.Block], pa.RecordBatch | None], schema: str, text: bool = False, end: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
        """What ``kernel`` makes of each block, with its scores as they are now; without ``text``, tokens and places aren't read. ``end``: what
        becomes of all that a task has made."""
        columns = self.rows.columns if text else postings.NO_TEXT
        moves = list(self.moves)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in postings.blocks_of(batch, columns):
                    block.moved(moves)
                    if (out := kernel(block)) is not None:
                        yield out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return end(each(batches))

        return self.rows.select(*columns).mapInArrow(run, schema)

    # --- scores ------------------------------------------------------------------------------------------------------

    def documents(self, wanted: dict[int, dict[str, str]] | None = None) -> DataFrame:
        """grp and for each response y<r>, f<r> and h<r>, whether the document holds the n-gram ``wanted`` for the response and group."""
        held = wanted or {}
        schema = "grp string, " + ", ".join(f"y{r} double, f{r} double, h{r} boolean" for r in range(self.responses))
        return self.blocks(lambda b: postings.documents(b, held), schema)

    def shift(self, r: int, deltas: dict[str, float], wanted: dict[str, str] | None = None) -> None:
        """Add each group's delta to the scores, of documents that hold the group's n-gram or of all."""
        if deltas:
            self.moves.append((r, {g: (None if wanted is None else wanted[g], float(d)) for g, d in deltas.items()}))

    def fold(self) -> None:
        """Write the blocks with their scores."""
        self._written(self.blocks(postings.row_of, postings.SCHEMA, text=True))

    def _written(self, blocks: DataFrame) -> None:
        """Write the blocks in place of the table before. A block's row may have megabytes: the writer looks at a group's size after
        each row and not after a hundred, else it (and later its reader) would hold a hundred of them."""
        spark, before, self.path = blocks.sparkSession, self.path, fresh_path(blocks.sparkSession, "frontier")
        sizes = {"parquet.block.size": GROUP_BYTES, "compression": "zstd"} | {f"parquet.{x}.row.check.{end}": n for x in ("block.size", "page.size") for end, n in (("min", 1), ("max", 4))}
        blocks.write.options(**sizes).parquet(self.path)
        self.rows, self.moves = spark.read.schema(blocks.schema).parquet(self.path), []
        if before:
            delete(spark, before)

    def close(self) -> None:
        """Delete the table; nothing can be asked of the tree after this."""
        delete(self.rows.sparkSession, self.path)

    # --- sums --------------------------------------------------------------------------------------------------------

    def _sums(self, fresh: bool, weights: dict[Model, dict[str, float]], nodes: list[Node] | None = None) -> DataFrame:
        """The sums of all n-grams, or of those of the last extension; with ``nodes``, of the children of these, which are not kept."""
        config, objective = self.config, self.config.objective
        schema = "grp string, gram string, size int, is_open boolean, support long, " + ", ".join(f"gradient{r} double, upos{r} double" for r in range(self.responses))
        if nodes is None:
            each = self.blocks(lambda b: postings.sums(b, objective, fresh), schema, end=postings.merged)
        else:
            chosen = by_group(nodes)
            each = self.blocks(lambda b: postings.sums(postings.children_of(b, chosen.get(b.grp, {}), config.maxpat, config.gaps, config.words), objective, True), schema, text=True, end=postings.merged)
        sums = [F.sum(c).alias(c) for r in range(self.responses) for c in (f"gradient{r}", f"upos{r}")]
        level = each.groupBy("grp", "gram").agg(F.sum("support").alias("support"), F.first("size").alias("size"), F.bool_or("is_open").alias("is_open"), *sums)
        level = level.where(F.col("support") >= self.config.minsup)
        reaches = {f"reach{r}": F.greatest(F.abs(f"upos{r}"), F.abs(F.col(f"gradient{r}") - F.col(f"upos{r}"))) for r in range(self.responses)}
        return self._penalised(level.withColumns(reaches), weights)

    def _penalised(self, level: DataFrame, weights: dict[Model, dict[str, float]]) -> DataFrame:
        """The penalty in the gradient of selected features and in the bounds of their prefixes."""
        config, level = self.config, level.withColumn("rewritten", F.lit(False))
        if not config.c or not any(weights.values()):
            return level
        extras: dict[tuple[str, str], list[float | None]] = {}
        ends: dict[tuple[str, str], list[list[float]]] = {}
        for (grp, r), own in weights.items():
            for g, w in own.items():
                extra = L.penalty_gradient(w, config.c, config.alpha)
                extras.setdefault((grp, g), [None] * self.responses)[r] = extra
                for p in [*T.prefixes(g, config.words), g]:
                    ends.setdefault((grp, p), [[] for _ in range(self.responses)])[r].append(extra)
        # as many rows as features and prefixes of theirs were selected in learning steps
        names = [f"{x}{r}" for r in range(self.responses) for x in ("extra", "low", "high")]
        kinds = "grp string, gram string, " + ", ".join(f"{n} double" for n in names)
        table = []
        for (grp, g), own in ends.items():
            selected = extras.get((grp, g), [None] * self.responses)
            table.append((grp, g, *(v for r in range(self.responses) for v in (selected[r], min(own[r], default=None), max(own[r], default=None)))))
        level = level.join(level.sparkSession.createDataFrame(table, kinds), ["grp", "gram"], "left")
        changed: dict[str, Column] = {"rewritten": F.lit(False)}
        for r in range(self.responses):
            up, un = F.col(f"upos{r}"), F.col(f"gradient{r}") - F.col(f"upos{r}")
            reach = F.greatest(F.col(f"reach{r}"), *[F.abs(u + F.coalesce(F.col(f"{e}{r}"), F.lit(0.0))) for u in (up, un) for e in ("low", "high")])
            changed["rewritten"] = changed["rewritten"] | (reach > F.col(f"reach{r}"))
            changed |= {f"reach{r}": reach, f"gradient{r}": F.col(f"gradient{r}") + F.coalesce(f"extra{r}", F.lit(0.0))}
        return level.withColumns(changed).drop(*names)

    def _look(self, level: DataFrame, best: dict[Model, Winner | None], floors: dict[Model, float]) -> Look:
        """Take the best of each model into ``best``; the open n-grams with the largest bounds, as many as the queue holds; one job, in
        which both read the same aggregation."""
        config, n = self.config, self.responses
        fits = F.col("size") >= config.minpat
        key = [F.min(F.when(fits & (F.round(F.abs(f"gradient{r}"), 9) > 0), F.struct((-F.round(F.abs(f"gradient{r}"), 9)).alias("k"), "size", "gram", F.col(f"gradient{r}").alias("gradient"), "support"))).alias(f"b{r}") for r in range(n)]
        # both parts below ask for the same columns of the sums, so that Spark makes these once
        reaches = [F.max(f"reach{r}").alias(f"most{r}") for r in range(n)]
        tops = level.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("rewritten").alias("rewritten"), F.count_if("is_open").alias("opened"), *key, *reaches).where("opened >= 0 and " + " and ".join(f"most{r} is not null" for r in range(n)))
        # a row for each group, and the queue
        tops = tops.select("grp", "n", "rewritten", F.array(*(f"b{r}" for r in range(n))).alias("best"), F.lit(None).cast("string").alias("gram"), F.lit(0).alias("size"), F.lit(None).cast("array<double>").alias("reach"))
        low: dict[str, float] = {}
        for (grp, r), b in best.items():
            least = max(round(abs(b.gradient), 9) if b else 0.0, round(floors.get((grp, r), 0.0), 9))
            low[grp] = min(low.get(grp, least), least)
        top = F.round(F.greatest(*(F.col(f"reach{r}") for r in range(n)), F.lit(0.0)), 9)
        open_ = level.where(F.col("is_open") & (F.col("size") < config.maxpat) & (top >= of_group(low))).withColumn("top", top)
        page = open_.orderBy(F.desc("top"), "grp", "gram").limit(QUEUE)
        zero = F.lit(0).cast("long")
        page = page.select("grp", zero.alias("n"), zero.alias("rewritten"), F.lit(None).cast(tops.schema["best"].dataType).alias("best"), "gram", "size", F.array(*(f"reach{r}" for r in range(n))).alias("reach"))
        out = Look([], 0, 0)
        for row in tops.unionByName(page).collect():
            if row["gram"] is not None:
                out.nodes.append(Node(row["grp"], row["gram"], row["size"], row["reach"]))
                continue
            out.n, out.rewritten = out.n + row["n"], out.rewritten + row["rewritten"]
            for r, b in enumerate(row["best"]):
                m = (row["grp"], r)
                if b is not None and m in best:
                    new = Winner(b["gram"], b["size"], b["gradient"], b["support"])
                    if round(abs(new.gradient), 9) > round(floors.get(m, 0.0), 9) and (best[m] is None or new.key < best[m].key):
                        best[m] = new
                        self.trail.setdefault(m, []).append(new)
        return out

    # --- extension ---------------------------------------------------------------------------------------------------

    def _expand(self, nodes: list[Node]) -> None:
        """Extend n-grams in every block that holds them, and write the blocks."""
        chosen, config = by_group(nodes), self.config
        self._written(self.blocks(lambda b: postings.row_of(postings.extended(b, set(chosen.get(b.grp, {})), config.maxpat, config.gaps, config.words)), postings.SCHEMA, text=True))

    def _plant(self, queue: list[Node], nodes: list[Node]) -> None:
        """Write the blocks with the queued n-grams and the children of ``nodes``."""
        queued, chosen, config = by_group(queue), by_group(nodes), self.config
        self._written(self.blocks(lambda b: postings.row_of(postings.planted(b, queued.get(b.grp, {}), chosen.get(b.grp, {}), config.maxpat, config.gaps, config.words)), postings.SCHEMA, text=True))

    # --- search ------------------------------------------------------------------------------------------------------

    def search(self, models: list[Model], weights: dict[Model, dict[str, float]] | None = None, floors: dict[Model, float] | None = None) -> dict[Model, Winner | None]:
        """The n-gram with the largest gradient of each of ``models``; all of them in the same jobs. ``floors``: only a larger
        gradient counts."""
        config, weights, floors = self.config, weights or {}, floors or {}
        best: dict[Model, Winner | None] = dict.fromkeys(models)
        orders = {"bfs": lambda x: (x.size, -max(x.reach), x.grp, x.gram), "best": lambda x: (-max(x.reach), x.grp, x.gram), "dfs": lambda x: (-x.size, -max(x.reach), x.grp, x.gram)}

        def asked(x: Node) -> bool:
            for r, reach in enumerate(x.reach):
                if (x.grp, r) in best:
                    b, reach = best[x.grp, r], round(reach, 9)
                    least = max(round(abs(b.gradient), 9) if b else 0.0, round(floors.get((x.grp, r), 0.0), 9))
                    if reach > least or b is not None and reach == least and x.size + 1 <= b.size:
                        return True
            return False

        if self.once and self.begun:
            raise ValueError("a tree that is asked once has no second search")
        self.trail = {}
        first = self._look(self._sums(False, weights), best, floors)
        self.counters = Counters(kept=first.n if self.begun else 0, fresh=0 if self.begun else first.n, rewritten=first.rewritten)
        self.begun, queue, more = True, first.nodes, first.full
        while True:
            queue = [x for x in queue if asked(x)]
            if not queue and more:  # the open ones that the queue had no room for
                again = self._look(self._sums(False, weights), best, floors)
                queue, more = [x for x in again.nodes if asked(x)], again.full
            if not queue:
                return best
            queue.sort(key=orders[config.traversal])
            limit = WAVE if config.traversal == "bfs" else BEAM
            wave, queue = queue[:limit], queue[limit:]
            if self.once and not more:
                made = self._look(self._sums(True, weights, wave), best, floors)
                if made.full or len(queue) + len(made.nodes) > QUEUE:
                    self._plant(queue, wave)
            else:
                self._expand(wave)
                made = self._look(self._sums(True, weights), best, floors)
            queue, more = queue + made.nodes, more or made.full
            if len(queue) > QUEUE:
                queue, more = sorted(queue, key=orders[config.traversal])[:QUEUE], True
            self.counters.fresh += made.n
            self.counters.rewritten += made.rewritten
            self.counters.expanded += len(wave)
            self.counters.waves += 1


def by_group(nodes: list[Node]) -> dict[str, dict[str, int]]:
    """The n-grams of each group with their sizes."""
    out: dict[str, dict[str, int]] = {}
    for x in nodes:
        out.setdefault(x.grp, {})[x.gram] = x.size
    return out


def of_group(values: dict[str, object]) -> Column:
    """The value of a row's group; null for other groups. As many as there are models."""
    if list(values) == [""]:
        return F.lit(values[""])
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("grp")) if values else F.lit(None)


def child_counts(docs: DataFrame, words: bool = False, known: DataFrame | None = None) -> DataFrame:
    """ngram, n (places) and support (documents) of all two-token n-grams of ``docs`` (seq), counted block by block before they are
    shuffled; ``known``: tokens (tok) that may end one."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    none = F.lit(0.0)
    rows = docs.select(F.lit("").alias("grp"), T.bare(F.col("seq"), words).alias("bare"), none.alias("y0"), none.alias("f0"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in postings.index_texts(batches, 1, False, words):
            for block in postings.blocks_of(row, row.schema.names):
                yield postings.child_counts(block, words)

    out = rows.mapInArrow(counted, "ngram string, n long, support long").groupBy("ngram").agg(F.sum("n").alias("n"), F.sum("support").alias("support"))
    if known is None:
        return out
    last = F.substring_index("ngram", " ", -1) if words else F.right("ngram", F.lit(1))
    return out.withColumn("tok", last).join(known.select("tok"), "tok", "left_semi").drop("tok")
