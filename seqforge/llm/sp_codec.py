"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A text is prefixed with the word mark, spaces become word marks, and it is cut before each run of marks: no piece has a
mark after another symbol, so no merge crosses a cut (checked when the model is loaded; a model that has such a piece is
encoded text by text, uncut). The distinct words of a batch lie one after another in a flat numpy array of symbols. Two
neighbours whose characters together are part of no piece never come to be in one symbol, so words fall into segments
there, and into more as symbols grow. A round finds the smallest pair rank of each segment, merges that segment's leftmost
pair of this rank, all segments at once, and compacts the array; segments without a pair are done. Merging one pair of a
segment at a time, best rank and then leftmost first, is what the sequential algorithm does, so the results are equal.
Where all pairs that a merge can make rank worse than it, the segment's other pairs of that rank that do not overlap are
next in turn, and merge in the same round. A long text without spaces is many segments, so its rounds are few.

Symbols out of the vocabulary fall back to byte pieces. Decoding joins the pieces' bytes, turns marks into spaces, drops
the first space, and replaces ill-formed UTF-8, as the library does.

Defined results: a null text counts as empty and has no ids; rows that repeat get a row each; ids of a null list decode
to the empty text; very long texts are encoded whole; an empty table gives no rows; extra columns pass through, and columns
of the added names are replaced. What a worker remembers of words is bounded and ends with its task.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.llm.text import arrow_column

MARK = "▁"
#: Words that a worker remembers with their ids, characters of these, and characters of new words that one flat array may hold.
CACHE_WORDS, CACHE_CHARS, FLAT_CHARS = 200_000, 4_000_000, 250_000
#: Characters of texts that are encoded at once, beyond the first text.
SLICE_CHARS = 1_000_000
#: A pair's value: its rank, then the piece that it makes, in one int32; above all of these: a pair that makes no piece, but whose
#: characters stand in one (_PART), and a pair that can never come to be in one symbol (_NONE).
_NONE, _PIECE_BITS = np.int32((1 << 31) - 1), 15
_PART = _NONE - np.int32(1)


class Words(dict):
    """Numbers words as they come; ``new`` has those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Codec:
    """Pieces, pair ranks and byte pieces of a model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are read")
        kinds = [p.type for p in model.pieces]
        if {4, 5} & set(kinds):
            raise ValueError("user-defined and unused pieces are not read")
        self.pieces = [p.piece for p in model.pieces]
        self.unk = kinds.index(2)
        self.byte_ids = np.zeros(256, np.int64)
        self.raw: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(self.pieces, kinds, strict=True)):
            if kind == 6:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append(b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else piece.replace(MARK, " ").encode())
        self.has_bytes = 6 in kinds
        normal_ids = [i for i, k in enumerate(kinds) if k == 1]
        self.ids = {self.pieces[i]: i for i in normal_ids}
        # ranks by score, best first; pieces of one score tie, and the leftmost of them merges first
        scores = sorted({model.pieces[i].score for i in normal_ids}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        left, right, ranks, results = [], [], [], []
        code = dict(self.ids)  # a character need not be a piece to take part in a merge
        for p in self.ids:
            for c in p if len(p) > 1 else "":
                code.setdefault(c, len(self.pieces) + len(code))
        for i in normal_ids:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = code.get(p[:cut]), code.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), ranks.append(rank[model.pieces[i].score]), results.append(i)
        left, right, ranks, results = (np.array(x, np.int64) for x in (left, right, ranks, results))
        if len(self.pieces) > 1 << _PIECE_BITS or len(scores) >= 1 << (30 - _PIECE_BITS):
            raise ValueError("the vocabulary is too large")
        # an open-addressed hash table of the pairs, and of those whose characters together are part of a piece
        parts = {p[i:j] for p in self.ids for i in range(len(p)) for j in range(i + 2, len(p) + 1)}
        near = np.array([(code[t[:k]], code[t[k:]]) for t in parts for k in range(1, len(t)) if t[:k] in code and t[k:] in code], np.int64).reshape(-1, 2)
        keys = np.concatenate([self._key(left, right), self._key(near[:, 0], near[:, 1])])
        values = np.concatenate([ranks << _PIECE_BITS | results, np.full(len(near), _PART, np.int64)]).astype(np.int32)
        keys, first = np.unique(keys, return_index=True)  # a pair that makes a piece stands before its repeat as a part
        values = values[first]
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            stay = np.ones(len(keys), bool)
            stay[put] = False
            keys, values, slots = keys[stay], values[stay], (slots[stay] + 1) & ((1 << self.bits) - 1)
        # All pairs of a rank in a word may merge at once if the pairs that this makes can only have worse ranks.
        own = np.full(len(self.pieces) + len(code), -1)
        own[results] = ranks
        self.safe = np.ones(len(scores) + 1, bool)
        for operand in (left, right):
            early = (own[operand] >= 0) & (ranks <= own[operand])
            self.safe[own[operand[early]]] = False
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.chars = -1 - np.arange(0x110000, dtype=np.int32)
        self.strange = {}
        for p, i in code.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
                if i >= len(self.pieces):
                    self.strange[i] = p
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.ends, self.held = Words(), np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Never a key of the table where a symbol is below 0."""
        return np.where((a | b) < 0, -2, (a.astype(np.int64) << 21) | b)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The value of each pair."""
        keys = self._key(a, b)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], _NONE)
        left = np.flatnonzero((held != keys) & (held >= 0) & (keys >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            found = held == keys[left]
            out[left[found]] = self.values[slot[left[found]]]
            left = left[~found & (held >= 0)]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (marks in place) one after another, and how many each has; rounds over all at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        n = len(symbols)
        place = np.arange(n, dtype=np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        value = np.full(n, _NONE)
        if n > 1:
            value[:-1] = np.where(word[:-1] == word[1:], self._lookup(symbols[:-1], symbols[1:]), _NONE)
        while n:
            first = np.flatnonzero(np.r_[True, value[:-1] == _NONE])  # a segment begins where no pair leads into it
            best = np.minimum.reduceat(value, first) >> _PIECE_BITS
            lengths = np.diff(np.r_[first, n])
            live = best < _NONE >> _PIECE_BITS
            if not live.all():  # segments without a pair left are ready
                keep = np.repeat(live, lengths)
                done.append((place[~keep], symbols[~keep]))
                place, symbols, value = place[keep], symbols[keep], value[keep]
                n = len(symbols)
                if not n:
                    break
                lengths, best = lengths[live], best[live]
            # the leftmost pair of the smallest rank in each segment; of a safe rank, all that do not overlap from the left
            fits = np.flatnonzero(value >> _PIECE_BITS == np.repeat(best, lengths))
            owner, made = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[fits], value[fits]
            leftmost = np.r_[True, owner[1:] != owner[:-1]]
            apart = leftmost | np.r_[True, fits[1:] != fits[:-1] + 1]
            turn = np.arange(len(fits))
            even = (turn - np.maximum.accumulate(np.where(apart, turn, 0))) % 2 == 0
            chosen = leftmost | (self.safe[made >> _PIECE_BITS] & even)
            at = fits[chosen]
            symbols[at] = made[chosen] & ((1 << _PIECE_BITS) - 1)
            value[at] = value[at + 1]
            stay = np.ones(n, bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            place, symbols, value = place[stay], symbols[stay], value[stay]
            n = len(symbols)
            # only the pairs beside the merged symbols are new, and only those that can still come together count
            beside = np.zeros(n, bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            touched = np.flatnonzero(beside & (value != _NONE))
            value[touched] = self._lookup(symbols[touched], symbols[touched + 1])
        place = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in done)])
        symbols = np.concatenate([np.zeros(0, np.int32), *(s for _, s in done)])
        order = np.argsort(place, kind="stable")
        word, symbols = word[place[order]], symbols[order]
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.pieces)))
        if len(odd):  # characters that are no piece
            spelled = [self._spell(x) for x in symbols[odd].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(x) for x in spelled]
            at = np.cumsum(times) - times
            word, symbols = np.repeat(word, times), np.repeat(symbols, times)
            for i, x in zip(at[odd].tolist(), spelled, strict=True):
                symbols[i : i + len(x)] = x
        return symbols, np.bincount(word, minlength=len(words))

    def _spell(self, symbol: int) -> list[int]:
        """The byte pieces of a character, or the unknown piece."""
        if not self.has_bytes:
            return [self.unk]
        return self.byte_ids[list((chr(-1 - symbol) if symbol < 0 else self.strange[symbol]).encode())].tolist()

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if len(self.words) > CACHE_WORDS or self.held > CACHE_CHARS:
            self.forget()
        cut = re.compile(f"{MARK}+[^{MARK}]*") if self.cuttable else re.compile("(?s).+")
        number = self.words.__getitem__
        texts_words = [np.fromiter(map(number, cut.findall(MARK + t.replace(" ", MARK))), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        self._encode_new()
        of = np.concatenate([np.zeros(0, np.int32), *texts_words])
        ends = self.ends[of]
        counts = ends - np.where(of > 0, self.ends[of - 1], 0)
        # the ids of each word, one after another: positions in the words' ids
        total = np.cumsum(counts)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(ends - total, counts)
        sizes = np.r_[0, total][np.cumsum([0, *map(len, texts_words)])]
        return self.flat[at], np.diff(sizes)

    def _encode_new(self) -> None:
        new, self.words.new = self.words.new, []
        flat, counts, begin, chars = [self.flat], [], 0, 0
        for i, w in enumerate(new):
            chars += len(w)
            self.held += len(w)
            if chars > FLAT_CHARS or i == len(new) - 1:
                ids, n = self.encode_words(new[begin : i + 1])
                flat.append(ids)
                counts.append(n)
                begin, chars = i + 1, 0
        if counts:
            start = len(self.flat)
            self.flat = np.concatenate(flat)
            self.ends = np.concatenate([self.ends, start + np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        flat, counts = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model: loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_model() -> str:
    """The file of the public 32k BPE model on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about SLICE_CHARS characters."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_CHARS:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield texts[begin:]


def encode_column(text: Column, model: str | None = None) -> Column:
    """array<int>: the ids of each text. ``model``: a path that each machine has; default: the public model there."""

    def encoder():
        own = codec(model or default_model())
        own.forget()

        def encode(texts: pa.Array) -> pa.Array:
            done = [own.encode_flat(part) for part in _slices([t or "" for t in texts.to_pylist()])]
            offsets = np.cumsum(np.concatenate([[0], *(n for _, n in done)])).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in done)])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

        weakref.finalize(encode, own.forget)
        return encode

    return arrow_column(encoder, "array<int>", text)


def decode_column(ids: Column, model: str | None = None) -> Column:
    """string: the text of each list of ids."""

    def decoder():
        own = codec(model or default_model())
        return lambda lists: pa.array([own.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in lists], pa.string())

    return arrow_column(decoder, "string", ids)


def encode_decode(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``; columns of these names are replaced."""
    return docs.withColumn("ids", encode_column(F.col(text_col), model)).withColumn("decoded", decode_column(F.col("ids"), model))


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`encode_decode` for each document."""
    return encode_decode(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
