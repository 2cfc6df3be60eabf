"""Which of many rules a document holds: a prefix tree of the rules, walked once over each batch of documents.

The tree's edges are (node, token) pairs in one sorted array, and a wildcard's edge leads on over any token. All places of a batch of
texts begin at the root and go down together, a level at a time: one binary search in the edges takes every place on that is
still alive. The work is in proportion to the places and the depth that their texts share with rules, whatever the number of
rules. A walk takes windows of so many places, so a task's memory depends neither on its batches nor on the length of a text: windows of a
long text overlap by the depth of the tree. Rules come from learning steps, so their tree fits the driver; tasks get it as a
broadcast of its arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession

from seqforge.functions import text as T
from seqforge.functions.arrow import arrow_column

#: Places that go down together.
PLACES = 1 << 16
WORD = re.compile(r"\S+")
HITS = "array<struct<ngram:string,weight:double>>"
TOTAL = "struct<score:double,n_rules:bigint>"


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once, by a sort: of many values it takes a fraction of the time of numpy's own, which hashes."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class RuleTree:
    """``rules``: (n-gram, weight), kept in the order of the n-grams."""

    def __init__(self, rules: list[tuple[str, float]], words: bool = False):
        self.words, self.rules = words, sorted(rules)
        self.names, self.weights = pa.array([g for g, _ in self.rules], pa.string()), np.array([w for _, w in self.rules], np.float64)
        self.depth = 1
        self.vocabulary: dict[str, int] = {}  # from 1; 0 is a token of no rule
        edges: dict[tuple[int, int], int] = {}
        wild: dict[int, int] = {}
        ends: dict[int, list[int]] = {}
        n = 1
        for i, (gram, _) in enumerate(self.rules):
            node, toks = 0, gram.split(" ") if words else gram
            self.depth = max(self.depth, len(toks))
            for tok in toks:
                held, at = (wild, node) if tok == T.WILD else (edges, (node, self.vocabulary.setdefault(tok, len(self.vocabulary) + 1)))
                if at not in held:
                    held[at] = n
                    n += 1
                node = held[at]
            if node:
                ends.setdefault(node, []).append(i)
        self.base = len(self.vocabulary) + 1
        keys = np.array([a * self.base + t for a, t in edges] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.array([*edges.values()] or [0], np.int64)[order]
        self.wild = np.full(n, -1, np.int64)
        self.wild[list(wild)] = list(wild.values())
        #: The rules that end at each node (equal n-grams are rules of their own).
        self.first = np.zeros(n + 1, np.int64)
        for node, own in ends.items():
            self.first[node + 1] = len(own)
        self.first = np.cumsum(self.first)
        self.ends = np.array([i for node in sorted(ends) for i in ends[node]], np.int64)
        if not words:
            points = np.array([ord(t) for t in self.vocabulary] or [0])
            self.codes = np.zeros(int(points.max()) + 2, np.int32)
            self.codes[points] = list(self.vocabulary.values()) or [0]

    def __getstate__(self) -> dict:
        """What a task needs: the rules are in arrays, and characters have their numbers in one."""
        return self.__dict__ | {"rules": None} | ({} if self.words else {"vocabulary": None})

    def encoded(self, text: str) -> Iterator[tuple[np.ndarray, int]]:
        """The tokens of parts of a text, and how many places of each begin a walk; the others are the next part's as well."""
        step, over = max(PLACES, self.depth), self.depth - 1
        if self.words:
            codes = np.fromiter((self.vocabulary.get(w.group(), 0) for w in WORD.finditer(text)), np.int32)
            for i in range(0, len(codes), step):
                yield codes[i : i + step + over], min(step, len(codes) - i)
        else:
            for i in range(0, len(text), step):
                points = np.frombuffer(text[i : i + step + over].encode("utf-32-le"), np.uint32)
                yield self.codes[np.minimum(points, len(self.codes) - 1)], min(step, len(text) - i)

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text and rule of each distinct pair, in this order."""
        pairs, window, size = [np.zeros(0, np.int64)], [], 0
        for k, text in enumerate(texts):
            for codes, begins in self.encoded(text or ""):
                window.append((k, codes, begins))
                size += begins
                if size >= PLACES:
                    pairs.append(self.walk(window))
                    window, size = [], 0
        if window:
            pairs.append(self.walk(window))
        every = distinct(np.concatenate(pairs))
        return every // max(1, len(self.names)), every % max(1, len(self.names))

    def walk(self, window: list[tuple[int, np.ndarray, int]]) -> np.ndarray:
        """Text times the number of rules, plus rule, of each distinct pair in a window of parts: (text, tokens, places that begin)."""
        codes, text = np.concatenate([c for _, c, _ in window]), np.array([k for k, _, _ in window], np.int64)
        ends, begins = np.cumsum([len(c) for _, c, _ in window]), np.array([n for _, _, n in window], np.int64)
        own = np.repeat(np.arange(len(window)), begins)
        first = ends - [len(c) for _, c, _ in window] - np.cumsum(begins) + begins
        waiting = [(np.zeros(len(own), np.int64), own, np.arange(len(own)) + first[own])]
        pairs, held = [np.zeros(0, np.int64)], 0
        while waiting:
            node, own, place = waiting.pop()
            if len(place) > 2 * PLACES:  # wildcards lead a place on to several nodes
                half = len(place) // 2
                waiting += [(node[half:], own[half:], place[half:]), (node[:half], own[:half], place[:half])]
                continue
            key = node * self.base + codes[place]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (codes[place] > 0)
            over = self.wild[node] >= 0
            node = np.r_[self.children[at[hit]], self.wild[node[over]]]
            own = np.r_[own[hit], own[over]]
            place = np.r_[place[hit], place[over]] + 1
            count = self.first[node + 1] - self.first[node]
            if count.any():
                rule = np.repeat(self.first[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pairs.append(distinct(np.repeat(text[own], count) * len(self.names) + self.ends[rule]))
                held += len(pairs[-1])
                if held > 4 * PLACES:  # equal pairs of other levels and halves
                    pairs = [distinct(np.concatenate(pairs))]
                    held = 0
            inside = place < ends[own]
            if inside.any():
                waiting.append((node[inside], own[inside], place[inside]))
        return distinct(np.concatenate(pairs))


def matched(bare_text: Column, rules: list[tuple[str, float]], words: bool) -> Column:
    """The distinct rules of ``bare_text`` (as ``T.bare`` has it), in the order of their n-grams."""
    shared = SparkSession.active().sparkContext.broadcast(RuleTree(rules, words))

    def reader():
        tree = shared.value
        weights = pa.array(tree.weights)

        def read(texts: pa.Array) -> pa.Array:
            text, rule = tree.found(texts.to_pylist())
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            taken = pa.array(rule)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([tree.names.take(taken), weights.take(taken)], ["ngram", "weight"]))

        return read

    return arrow_column(reader, HITS, bare_text)


def summed(bare_text: Column, rules: list[tuple[str, float]], words: bool, offset: float) -> Column:
    """``offset`` and the weights of the distinct rules of ``bare_text``, added up one by one in the order of their n-grams, and how many
    they are: what :func:`matched` has, without a row's n-grams being made and sent."""
    shared = SparkSession.active().sparkContext.broadcast(RuleTree(rules, words))

    def reader():
        tree = shared.value

        def read(texts: pa.Array) -> pa.Array:
            text, rule = tree.found(texts.to_pylist())
            score = np.bincount(np.r_[np.arange(len(texts)), text], np.r_[np.full(len(texts), offset), tree.weights[rule]], len(texts))
            return pa.StructArray.from_arrays([pa.array(score), pa.array(np.bincount(text, minlength=len(texts)).astype(np.int64))], ["score", "n_rules"])

        return read

    return arrow_column(reader, TOTAL, bare_text)
