"""Blocks of documents with the inverted index of the n-grams found in them so far, as rows of a table.

A block is a few hundred documents of one group. It holds their tokens as numbers of its own vocabulary, their responses and
scores, and for every n-gram that a search has come to (a node) the documents that hold it. The places of the n-grams that are being
extended are found anew in the tokens, by one walk of these n-grams' prefix tree: kept, they would be many times as large as the text.
Sums over a block's nodes and extensions of its nodes are vector operations on these arrays; Spark deals
the blocks to tasks and adds up what they give. A block's size is bounded in documents and tokens, so only a document that is longer by itself makes a larger one.

Arrays are binary columns (little-endian; whole numbers in as few bytes as their largest takes, starts as differences), so that a
pass that needs no text and no vocabulary doesn't read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqforge.functions import loss as L
from seqforge.functions import text as T

#: Documents and tokens of a block.
DOCS, TOKENS = 1024, 1 << 18
#: Sums that a task holds to add up those of its blocks before it gives them on.
MERGE = 1 << 18
_ARRAYS = {"y": np.float64, "f": np.float64, "codes": np.int32, "starts": np.int32, "sizes": np.int32, "closed": np.int8, "doc_starts": np.int32, "docs": np.int32}
#: Tokens from which a walk begins at once, and the most cells of its steps as a table (beyond, they are looked up by bisection).
WALK, TABLE = 1 << 14, 1 << 22
SCHEMA = "grp string, n int, fresh int, vocab array<string>, names array<string>, " + ", ".join(f"{c} binary" for c in _ARRAYS)
#: What a pass over sums and scores reads: neither tokens nor places.
NO_TEXT = ["grp", "n", "fresh", "names", "sizes", "closed", "y", "f", "doc_starts", "docs"]

#: A change of the scores of response r: by group, the n-gram whose documents move (None: all) and by how much.
Move = tuple[int, dict[str, tuple[str | None, float]]]


@dataclass
class Block:
    """``n`` documents; tokens of document i are codes[starts[i]:starts[i + 1]]. Node k: names[k], sizes[k] tokens and wildcards, closed or
    not, documents docs[doc_starts[k]:doc_starts[k + 1]]; nodes from ``fresh`` on are of the last extension. y and f: a row for each
    response."""

    grp: str
    n: int
    fresh: int
    vocab: list[str]
    names: pa.Array
    y: np.ndarray
    f: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    closed: np.ndarray
    doc_starts: np.ndarray
    docs: np.ndarray

    def moved(self, moves: list[Move]) -> None:
        """Apply changes of the scores."""
        for r, by_group in moves:
            gram, delta = by_group.get(self.grp, (None, 0.0))
            if gram is None:
                self.f[r] += delta
            else:
                self.f[r, self.holding(gram)] += delta

    def holding(self, gram: str) -> np.ndarray:
        """The documents with an n-gram."""
        k = pc.index(self.names, gram).as_py()
        return self.docs[self.doc_starts[k] : self.doc_starts[k + 1]] if k >= 0 else np.zeros(0, np.int32)


def blocks_of(batch: pa.RecordBatch, columns: list[str]) -> Iterator[Block]:
    """The blocks of a batch's rows; what was not read is empty."""
    for i in range(batch.num_rows):
        given = {}
        for c in (x.name for x in fields(Block)):
            if c in _ARRAYS:
                raw = batch.column(c)[i].as_buffer() if c in columns else b""
                given[c] = unpacked(raw, c)
            elif c == "names":
                given[c] = batch.column(c)[i].values
            elif c == "vocab":
                given[c] = batch.column(c)[i].as_py() if c in columns else []
            else:
                given[c] = batch.column(c)[i].as_py()
        n = given["n"]
        given |= {c: given[c].reshape(-1, n).copy() for c in ("y", "f")}
        yield Block(**given)


def row_of(b: Block) -> pa.RecordBatch:
    out = {"grp": pa.array([b.grp], pa.string()), "n": pa.array([b.n], pa.int32()), "fresh": pa.array([b.fresh], pa.int32()), "vocab": pa.array([b.vocab], pa.list_(pa.string()))}
    out["names"] = pa.ListArray.from_arrays(pa.array([0, len(b.names)], pa.int32()), b.names)
    out |= {c: pa.array([packed(getattr(b, c), c)], pa.binary()) for c in _ARRAYS}
    return pa.RecordBatch.from_pydict(out)


def packed(x: np.ndarray, name: str) -> bytes:
    """An array's bytes; whole numbers by the narrowest kind, whose width is the first byte."""
    if _ARRAYS[name] is not np.int32:
        return np.ascontiguousarray(x, _ARRAYS[name]).tobytes()
    x = np.diff(x, prepend=0) if name.endswith("starts") else x
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def unpacked(raw: bytes | pa.Buffer, name: str) -> np.ndarray:
    if _ARRAYS[name] is not np.int32 or not len(raw):
        return np.frombuffer(raw, _ARRAYS[name])
    x = np.frombuffer(raw, f"u{memoryview(raw)[0]}", offset=1)
    return np.cumsum(x, dtype=np.int32) if name.endswith("starts") else x.astype(np.int32)


def index_texts(batches: Iterator[pa.RecordBatch], responses: int, only: bool, words: bool) -> Iterator[pa.RecordBatch]:
    """Documents (grp, bare as ``T.bare`` has it, y<r>, f<r>; rows of a group together) as blocks with their single tokens as nodes.
    ``only``: no node will be extended."""
    held: list[tuple[str, list[str] | str, list[float], list[float]]] = []
    size = 0
    for batch in batches:
        columns = [batch.column(f"{c}{r}").to_pylist() for c in "yf" for r in range(responses)]
        for i, grp in enumerate(batch.column("grp").to_pylist()):
            text = batch.column("bare")[i].as_py() or ""
            toks = text.split() if words else text
            if held and (grp != held[-1][0] or len(held) == DOCS or size + len(toks) > TOKENS):
                yield row_of(_first_nodes(held, only, words))
                held, size = [], 0
            held.append((grp, toks, [c[i] for c in columns[:responses]], [c[i] for c in columns[responses:]]))
            size += len(toks)
    if held:
        yield row_of(_first_nodes(held, only, words))


def _first_nodes(held: list[tuple[str, list[str] | str, list[float], list[float]]], only: bool, words: bool) -> Block:
    if words:
        number: dict[str, int] = {}
        codes = np.array([number.setdefault(t, len(number)) for _, toks, _, _ in held for t in toks], np.int32)
        vocab = list(number)
    else:
        points = np.frombuffer("".join(toks for _, toks, _, _ in held).encode("utf-32-le"), np.uint32)
        seen = np.flatnonzero(np.bincount(points)) if len(points) else points
        table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int32)
        table[seen] = np.arange(len(seen))
        codes, vocab = table[points], [chr(x) for x in seen.tolist()]
    starts = np.r_[0, np.cumsum([len(toks) for _, toks, _, _ in held])].astype(np.int32)
    y, f = (np.array([h[k] for h in held], np.float64).reshape(len(held), -1).T for k in (2, 3))
    short = codes.astype(np.uint16) if len(vocab) < 1 << 16 else codes  # sorted by digits
    order = np.argsort(short, kind="stable").astype(np.int32)
    block = Block(held[0][0], len(held), 0, vocab, pa.array(vocab, pa.string()), y, f, codes, starts, np.ones(len(vocab), np.int32), np.full(len(vocab), only, np.int8), *[np.zeros(0, np.int32)] * 2)
    block.doc_starts, block.docs = _documents(block, order, np.searchsorted(codes[order], np.arange(len(vocab) + 1)).astype(np.int32))
    return block


def _documents(block: Block, places: np.ndarray, place_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct documents of nodes whose places, ascending, are given one node after another."""
    docs = (np.searchsorted(block.starts, places, "right") - 1).astype(np.int32)
    node = np.repeat(np.arange(len(place_starts) - 1), np.diff(place_starts))
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (node[1:] != node[:-1])
    return np.r_[0, np.cumsum(new)][place_starts].astype(np.int32), docs[new]


def places_of(b: Block, hits: np.ndarray, words: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the nodes ``hits`` every place where one ends: the node's number among them, and the place; as many as begin in ``WALK`` tokens at
    once. All places of the tokens go down the nodes' prefix tree together, a level at a time; a wildcard's edge leads on over any token
    of the document."""
    number = {t: i for i, t in enumerate(b.vocab)}
    edges: dict[tuple[int, int], int] = {}
    wild: dict[int, int] = {}
    ends: dict[int, int] = {}
    n = 1
    for i, gram in enumerate(b.names.take(pa.array(hits)).to_pylist()):
        at = 0
        for tok in gram.split(" ") if words else gram:
            held, key = (wild, at) if tok == T.WILD else (edges, (at, number[tok]))
            if key not in held:
                held[key] = n
                n += 1
            at = held[key]
        ends[at] = i
    if not edges or not len(b.codes):
        return
    keys = np.array([x * len(b.vocab) + t for x, t in edges], np.int64)
    below = np.array([*edges.values()], np.int32)
    over, ending = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    over[list(wild)], ending[list(ends)] = list(wild.values()), list(ends.values())
    if n * len(b.vocab) <= TABLE:
        step = np.full(n * len(b.vocab), -1, np.int32)
        step[keys] = below
        goes = step.take
    else:
        order = np.argsort(keys)
        keys, below = keys[order], below[order]

        def goes(key: np.ndarray) -> np.ndarray:
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[found] == key, below[found], -1)

    behind = b.starts[np.searchsorted(b.starts, np.arange(len(b.codes)), "right")]  # where each token's document ends
    for first in range(0, len(b.codes), WALK):
        at = np.arange(first, min(first + WALK, len(b.codes)), dtype=np.int32)
        node = np.zeros(len(at), np.int32)
        own, place = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        while len(at):
            to, free = goes(node.astype(np.int64) * len(b.vocab) + b.codes[at]), over[node]
            node, at = np.r_[to[to >= 0], free[free >= 0]], np.r_[at[to >= 0], at[free >= 0]]
            done = ending[node]
            own.append(done[done >= 0])
            place.append(at[done >= 0])
            inside = at + 1 < behind[at]
            node, at = node[inside], at[inside] + 1
        yield np.concatenate(own), np.concatenate(place)


def grown(b: Block, hits: np.ndarray, maxpat: int, gaps: tuple[int, int], words: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The children of the nodes ``hits``: names, sizes, where each one's documents begin among the documents, these, and in how many
    places each one is. A child and a document of its places are one number, by which places are sorted."""
    total, run = T.gap_limits(*gaps)
    sep, doc = " " if words else "", np.searchsorted(b.starts, np.arange(len(b.codes)), "right") - 1  # of each token
    ends = b.starts[doc + 1]  # of its document
    parents = b.names.take(pa.array(hits))
    wilds = pc.count_substring(parents, T.WILD).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = range(min(run, maxpat) + 1 if run else 1)
    kind = np.uint32 if len(hits) * len(b.vocab) * b.n < 1 << 32 else np.int64
    codes, doc = b.codes.astype(kind), doc.astype(kind)
    found: list[list[np.ndarray]] = [[] for _ in runs]
    for node, place in places_of(b, hits, words):
        for wild in runs:
            fits = (b.sizes[hits] + wild + 1 <= maxpat) & (wilds + wild <= total)
            ok = fits[node] & (place + wild + 1 < ends[place])
            at, own = place[ok] + (wild + 1), node[ok]
            if len(at):
                found[wild].append((own.astype(kind) * kind(len(b.vocab)) + codes[at]) * kind(b.n) + doc[at])
    vocab = pa.array(b.vocab, pa.string())
    new_names, new_sizes, new_starts, new_docs, new_n = [pa.array([], pa.string())], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for wild in runs:
        if not found[wild]:
            continue
        pair, found[wild] = np.concatenate(found[wild]), []
        pair.sort()
        once = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        n, pair = np.diff(np.r_[once, len(pair)]), pair[once]
        key = pair // kind(b.n)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        parent, tok = np.divmod(key[first].astype(np.int64), len(b.vocab))
        new_names.append(pc.binary_join_element_wise(parents.take(pa.array(parent)), vocab.take(pa.array(tok)), (sep + T.WILD) * wild + sep))
        new_sizes.append(b.sizes[hits[parent]] + wild + 1)
        new_starts.append(new_starts[-1][-1] + np.r_[first[1:], len(key)])
        new_docs.append((pair - key * kind(b.n)).astype(np.int32))
        new_n.append(np.add.reduceat(n, first))
    return pa.concat_arrays(new_names), *(np.concatenate(x).astype(k) for x, k in ((new_sizes, np.int32), (new_starts, np.int32), (new_docs, np.int32), (new_n, np.int64)))


def extended(b: Block, chosen: set[str], maxpat: int, gaps: tuple[int, int], words: bool) -> Block:
    """The block with its open nodes that are among ``chosen`` closed, and with their children as fresh nodes: the n-gram and the token
    behind each of its places, or behind up to a run of wildcards after it."""
    asked = pc.is_in(b.names, value_set=pa.array(sorted(chosen), pa.string())).to_numpy(zero_copy_only=False)
    hits = np.flatnonzero(asked & (b.closed == 0))
    names, sizes, doc_starts, docs, _ = grown(b, hits, maxpat, gaps, words)
    closed = b.closed.copy()
    closed[hits] = 1
    full = sizes >= maxpat  # never extended
    return Block(b.grp, b.n, len(b.names), b.vocab, pa.concat_arrays([b.names, names]), b.y, b.f, b.codes, b.starts, np.r_[b.sizes, sizes], np.r_[closed, full.astype(np.int8)], np.r_[b.doc_starts, b.doc_starts[-1] + doc_starts[1:]], np.r_[b.docs, docs])


def seeded(b: Block, grams: dict[str, int], words: bool) -> Block:
    """The block with n-grams (and their sizes) as its only nodes, those that its vocabulary allows, open and without documents."""
    known = {*b.vocab, T.WILD}
    names = [g for g in grams if known.issuperset(g.split(" ") if words else g)]
    sizes = np.array([grams[g] for g in names], np.int32)
    return replace(b, fresh=len(names), names=pa.array(names, pa.string()), sizes=sizes, closed=np.zeros(len(names), np.int8), doc_starts=np.zeros(len(names) + 1, np.int32), docs=np.zeros(0, np.int32))


def located(b: Block, words: bool) -> Block:
    """The block with the documents of its nodes found in the tokens."""
    pairs = [np.zeros(0, np.int64)]
    for node, place in places_of(b, np.arange(len(b.names)), words):
        pairs.append(np.unique(node.astype(np.int64) * b.n + np.searchsorted(b.starts, place, "right") - 1))
    node, docs = np.divmod(np.unique(np.concatenate(pairs)), b.n)
    return replace(b, doc_starts=np.searchsorted(node, np.arange(len(b.names) + 1)).astype(np.int32), docs=docs.astype(np.int32))


def children_of(b: Block, grams: dict[str, int], maxpat: int, gaps: tuple[int, int], words: bool) -> Block:
    """The block with the children of n-grams, which need not be nodes of it, as its fresh nodes."""
    return extended(seeded(b, grams, words), set(grams), maxpat, gaps, words)


def planted(b: Block, queued: dict[str, int], grams: dict[str, int], maxpat: int, gaps: tuple[int, int], words: bool) -> Block:
    """The block with the n-grams ``queued`` and the children of ``grams`` as its only nodes."""
    own, new = located(seeded(b, queued, words), words), children_of(b, grams, maxpat, gaps, words)
    k = new.fresh
    made = {c: np.r_[getattr(own, c), getattr(new, c)[k:]] for c in ("sizes", "closed")}
    starts = np.r_[own.doc_starts, own.doc_starts[-1] + new.doc_starts[k + 1 :] - new.doc_starts[k]]
    return replace(own, names=pa.concat_arrays([own.names, new.names[k:]]), doc_starts=starts, docs=np.r_[own.docs, new.docs[new.doc_starts[k] :]], **made)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's :func:`sums` with those of an n-gram added up, as far as ``MERGE`` rows go."""
    held: list[pa.RecordBatch] = []
    n = 0

    def added() -> list[pa.RecordBatch]:
        names = held[0].schema.names
        kinds = {"size": "max", "is_open": "any"}
        how = [(c, kinds.get(c, "sum")) for c in names[2:]]
        out = pa.Table.from_batches(held).group_by(names[:2], use_threads=False).aggregate(how)
        return out.select(names[:2] + [f"{c}_{k}" for c, k in how]).rename_columns(names).cast(held[0].schema).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > MERGE and len(held) > 1:
            held = added()
            n = sum(x.num_rows for x in held)
        if n > MERGE // 2:
            yield from held
            held, n = [], 0
    if held:
        yield from added()


def sums(b: Block, objective: str, fresh: bool) -> pa.RecordBatch | None:
    """grp, gram, size, is_open, support and for each response gradient<r> and upos<r> of the nodes, or of fresh ones alone."""
    first = b.fresh if fresh else 0
    starts = b.doc_starts[first:].astype(np.int64)
    n = len(starts) - 1
    if n <= 0:
        return None
    docs, at = b.docs[starts[0] : starts[-1]], starts[:-1] - starts[0]
    names = b.names[first:]
    out = {"grp": pa.array([b.grp] * n, pa.string()), "gram": names, "size": pa.array(b.sizes[first:]), "is_open": pa.array(b.closed[first:] == 0), "support": pa.array(np.diff(starts))}
    for r in range(len(b.y)):
        pull = L.pull_values(objective, b.y[r], b.f[r])[docs]
        out |= {f"gradient{r}": pa.array(-np.add.reduceat(pull, at)), f"upos{r}": pa.array(-np.add.reduceat(np.maximum(pull, 0.0), at))}
    return pa.RecordBatch.from_pydict(out)


def documents(b: Block, wanted: dict[int, dict[str, str]]) -> pa.RecordBatch:
    """grp and for each response y<r>, f<r> and h<r>, whether the document holds the n-gram that is ``wanted`` for its group."""
    out = {"grp": pa.array([b.grp] * b.n, pa.string())}
    for r in range(len(b.y)):
        has = np.zeros(b.n, bool)
        if gram := wanted.get(r, {}).get(b.grp):
            has[b.holding(gram)] = True
        out |= {f"y{r}": pa.array(b.y[r]), f"f{r}": pa.array(b.f[r]), f"h{r}": pa.array(has)}
    return pa.RecordBatch.from_pydict(out)


def child_counts(b: Block, words: bool) -> pa.RecordBatch:
    """ngram, n (places) and support (documents) of the children of a block's single tokens."""
    names, _, doc_starts, _, n = grown(b, np.arange(len(b.names)), 2, (0, 0), words)
    return pa.RecordBatch.from_pydict({"ngram": names, "n": pa.array(n), "support": pa.array(np.diff(doc_starts).astype(np.int64))})
