"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

Units of a sentence are its runs of characters other than white space, A-Z lower-cased and without ASCII marks, and
runs of single letters joined. The subsequence kernel of two strings counts their common subsequences of ``ORDER`` bytes,
each decayed by the span that it covers on both sides, is normalised to one for equal strings, and raised to ``POWER`` (a
product of kernels). The value of a unit and a landmark is the largest kernel value of the landmark and a window of the
unit that is ``SLACK`` bytes longer than the landmark (the whole unit, where it is no longer than that). Only
values below ``FLOOR`` (a kernel of 0.31) count as none: an insult keeps part of its value with characters put in, dropped,
changed or swapped, and all of it with marks or spaces between its letters. The values are sums over the subsequences of a window, looked up in a table of
those of the landmarks; subsequences that no landmark has add nothing.

Landmarks are pieces of units, (nearly) never part of a unit of a clean text, that greedily cover the units which tell the
toxic training texts from the clean ones. The kernel values are whitened by the landmarks' own kernel matrix (the Nystrom
features), and a linear SVM (squared hinge) learns on labelled sentences: every unit of the sentences of clean texts, and of
each toxic text, whose label holds for some sentence of it, the unit that responds most and those that respond clearly,
chosen anew by the machine's margin in each of ``ROUNDS`` rounds. These units with a character put in, dropped, changed or
swapped are virtual examples of a share of ``VIRTUAL`` of their weight. A sentence's margin is the largest of its units, and a text's that of its
sentences; the score is a logistic function of it, fitted to the training texts.

Training takes a bounded sample: up to ``max_toxic`` and ``max_clean`` labelled texts of at most ``max_bytes`` bytes by a
hash of the id. Scoring takes whole texts; a worker remembers units up to ``CACHE_BYTES``, for one task.

Defined results: null and empty texts have the score of a text without any response; without toxic or without clean
training texts all scores are the toxic share (0 without labels); labels that are null are left out, of labels that repeat
the largest counts; texts that repeat get a row each; a null id is not held out (its text is scored all the same); very
long texts are scored whole, in slices; an empty table gives no rows; extra columns pass through, and a column of the
added name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqforge.llm.near_dup import WordHashes, lanes, shingle_hashes
from seqforge.llm.text import arrow_column, byte_values, chunks, give_back, slices_of

#: Subsequence length, decay, power of the kernel, bytes of a window beyond the landmark's, and the most landmarks.
ORDER, DECAY, POWER, SLACK, MAX_LANDMARKS = 3, 0.8, 3, 2, 128
#: Values below this one count as none.
FLOOR = 0.03
#: The training sample: texts of each kind and bytes of a text.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2000, 3000, 8000
#: Units that a worker remembers and their bytes, units of a slice, windows compared at once, rounds of choosing units, and
#: the share of virtual examples.
CACHE_UNITS, CACHE_BYTES, SLICE, WINDOWS, ROUNDS, VIRTUAL = 150_000, 16 << 20, 1 << 16, 4096, 4, 1.0
#: Weight of all clean units together, in that of all toxic ones, and the value from which a unit of a toxic text is first taken for toxic.
CLEAN, RESPONSE = 1000.0, 0.5
_SPELLED = re.compile(rb"(?<![a-z0-9\x80-\xff])(?:[a-z][ ._*-]+){2,}[a-z](?![a-z0-9\x80-\xff])")
_MARKS = bytes(b for b in range(33, 128) if not (48 <= b <= 57 or 97 <= b <= 122))


def ssk(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of each pair of rows (bytes, padded with 0)."""
    same = ((left[:, :, None] == right[:, None, :]) & (left[:, :, None] > 0)) * decay**2
    ends = same
    for _ in range(order - 1):
        rows = np.zeros_like(ends)
        for i in range(1, ends.shape[1]):
            rows[:, i] = decay * rows[:, i - 1] + ends[:, i - 1]
        both = np.zeros_like(ends)
        for j in range(1, ends.shape[2]):
            both[:, :, j] = decay * both[:, :, j - 1] + rows[:, :, j - 1]
        ends = same * both
    return ends.sum(axis=(1, 2))


def padded(strings: list[bytes]) -> np.ndarray:
    size = max(map(len, strings), default=1)
    return np.frombuffer(b"".join(s.ljust(size, b"\0") for s in strings), np.uint8).reshape(len(strings), size)


class Kernel:
    """Kernel values of units against landmarks, which stand in the order of their lengths."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = sorted(landmarks, key=lambda z: (len(z), z))
        m = len(self.landmarks)
        letters = sorted(set(b"".join(self.landmarks)))
        #: Each byte's letter; a byte of no landmark is the last one and has no subsequence in the table.
        self.code = np.full(256, len(letters), np.int32)  # base**ORDER stays below 2**31: 256 letters at most
        self.code[letters] = np.arange(len(letters))
        self.base = len(letters) + 1
        features: dict[int, dict[int, float]] = {}
        for k, z in enumerate(self.landmarks):
            at = self._features(np.frombuffer(z, np.uint8)[None])[0]
            for f, w in zip(at.tolist(), _triples(len(z))[3].tolist(), strict=True):
                of = features.setdefault(f, {})
                of[k] = of.get(k, 0.0) + w
        #: The table's row of each subsequence, 0 for those that no landmark has.
        self.row = np.zeros(self.base**ORDER, np.int32)
        self.table = np.zeros((len(features) + 1, m), np.float32)
        for i, (f, of) in enumerate(features.items(), 1):
            self.row[f] = i
            self.table[i, list(of)] = list(of.values())
        self.own = np.sqrt((self.table.astype(np.float64) ** 2).sum(axis=0))
        #: Windows of each width and the first landmark that they are for.
        sizes = np.array([len(z) for z in self.landmarks], np.int64) + SLACK
        self.widths = [(int(w), int(np.searchsorted(sizes, w)), int(np.searchsorted(sizes, w, "right"))) for w in np.unique(sizes)]

    def _features(self, strings: np.ndarray) -> np.ndarray:
        i, j, k, _ = _triples(strings.shape[1])
        code = self.code[strings]
        return (code[:, i] * self.base + code[:, j]) * self.base + code[:, k]

    def whole(self, strings: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Normalised kernel values of strings of one length against the landmarks from ``begin`` to ``end``."""
        out = np.zeros((len(strings), end - begin), np.float32)
        rows = self.row[self._features(strings)]
        at, place = np.nonzero(rows)
        if not len(at):
            return out
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        weight = _triples(strings.shape[1])[3].astype(np.float32)
        sums = np.add.reduceat(weight[place][:, None] * self.table[rows[at, place], begin:end], first) / self.own[begin:end]
        # a byte that repeats only adds to a string's own value, so without that this is an upper bound
        likely = sums.max(axis=1) >= FLOOR ** (1 / POWER) * (1 - 1e-6) * (_triples(strings.shape[1])[3] ** 2).sum() ** 0.5
        found = at[first][likely]
        got = (sums[likely] / np.sqrt(own_values(strings[found]))[:, None]) ** POWER
        out[found] = np.where(got >= FLOOR, got, 0)
        return out

    def matrix(self) -> np.ndarray:
        return ((self.table.astype(np.float64).T @ self.table) / np.outer(self.own, self.own)) ** POWER

    def values(self, units: list[bytes]) -> np.ndarray:
        """A row of values for each unit (without marks)."""
        m = len(self.landmarks)
        out = np.zeros((len(units), m), np.float32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        for n in np.unique(sizes).tolist() if m else ():
            of = np.flatnonzero(sizes == n)
            step = max(1, 8 * WINDOWS // max(1, n))
            for some in (of[i : i + step] for i in range(0, len(of) if n >= ORDER else 0, step)):
                strings = np.frombuffer(b"".join([units[i] for i in some.tolist()]), np.uint8).reshape(-1, n)
                begin = next((b for w, b, _ in self.widths if w >= n), m)
                if begin < m:
                    for x in range(0, len(some), WINDOWS):
                        out[some[x : x + WINDOWS], begin:] = self.whole(strings[x : x + WINDOWS], begin, m)
                for width, b, e in self.widths:
                    if width < n:
                        windows = np.lib.stride_tricks.sliding_window_view(strings, width, axis=1)
                        for x in range(0, n - width + 1, WINDOWS):  # all windows of many short units, or some of a long one
                            part = windows[:, x : x + WINDOWS]
                            got = self.whole(part.reshape(-1, width), b, e).reshape(len(some), -1, e - b).max(axis=1)
                            out[some, b:e] = np.maximum(out[some, b:e], got)
        return out


_of_size: dict[int, tuple[np.ndarray, ...]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of all subsequences of a string of ``n`` bytes, and the decay of each."""
    if n not in _of_size:
        found = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], np.int64).reshape(-1, ORDER)
        _of_size[n] = (*found.T, DECAY ** (found[:, 2] - found[:, 0] + 1))
    return _of_size[n]


def own_values(strings: np.ndarray) -> np.ndarray:
    """The kernel of each string with itself: a constant unless a byte repeats."""
    n = strings.shape[1]
    out = np.full(len(strings), (_triples(n)[3] ** 2).sum())
    ordered = np.sort(strings, axis=1)
    again = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
    for i in range(0, len(again), 2000):
        some = again[i : i + 2000]
        out[some] = ssk(strings[some], strings[some])
    return out


def units_of(text: bytes) -> list[bytes]:
    """The units in their order, and after them the runs of spelled-out letters, joined."""
    lower = text.lower()
    return lower.split() + [re.sub(rb"[^a-z]", b"", m) for m in _SPELLED.findall(lower)]


class Units(dict):
    """Numbers units as they come."""

    def __missing__(self, unit: bytes) -> int:
        self[unit] = n = len(self)
        return n


class Margins:
    """Margins of units; remembers units up to a bound."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, bias: float):
        self.kernel, self.weights, self.bias = kernel, weights, bias
        self.forget()

    def forget(self) -> None:
        self.known, self.bytes = Units(), 0
        self.table = np.zeros(0, np.float32)

    def of(self, units: list[bytes]) -> np.ndarray:
        """The margin of each unit, as it stands in the text (with its marks)."""
        out = []
        for i in range(0, len(units), SLICE):
            if len(self.known) > CACHE_UNITS or self.bytes > CACHE_BYTES:
                self.forget()
            n = len(self.known)
            at = np.fromiter(map(self.known.__getitem__, units[i : i + SLICE]), np.int64, min(SLICE, len(units) - i))
            if len(self.known) > n:
                new = list(islice(reversed(self.known), len(self.known) - n))[::-1]
                self.bytes += sum(map(len, new))
                values = self.kernel.values([u.translate(None, _MARKS) for u in new])
                self.table = np.concatenate([self.table, (values @ self.weights + self.bias).astype(np.float32)])
            out.append(self.table[at])
        return np.concatenate([*out, np.zeros(0, np.float32)])


class Model:
    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float, slope: float, offset: float):
        self.kernel = Kernel(landmarks)
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def reader(self) -> Margins:
        return Margins(self.kernel, self.weights, self.bias)

    def margins(self, texts: list[bytes], reader: Margins | None = None) -> np.ndarray:
        """The largest margin of each text's units, or that of a unit without response."""
        out = np.full(len(texts), float(self.bias))
        if not self.kernel.landmarks:
            return out
        reader = reader or self.reader()
        units: list[bytes] = []
        owner: list[tuple[int, int]] = []

        def flush() -> None:
            if units:
                found = np.maximum.reduceat(reader.of(units), [i for _, i in owner])
                for (k, _), v in zip(owner, found.tolist(), strict=True):
                    out[k] = max(out[k], v)
            units.clear(), owner.clear()

        for k, text in enumerate(texts):
            for part in slices_of(text):
                if more := units_of(part):
                    owner.append((k, len(units)))
                    units += more
                if len(units) > SLICE:
                    flush()
        flush()
        return out

    def scores(self, texts: list[bytes], reader: Margins | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts, reader) + self.offset, -500, 500)))


def pieces(unit: bytes, least: int = 4, most: int = 10):
    for word in re.findall(rb"[a-z\x80-\xff]+", unit):
        for size in range(least, min(most, len(word)) + 1):
            for i in range(len(word) - size + 1):
                yield word[i : i + size]


def families(texts: list[bytes]) -> list[set[bytes]]:
    """The units of each text, those of near copies (as a rule from a similarity of 0.8) together."""
    known, of_band, same, out = WordHashes(), {}, {}, []
    for t in dict.fromkeys(texts):
        if not (units := chunks(t)):
            continue
        bands = list(enumerate(map(bytes, lanes(shingle_hashes(units, known, 2), 0, 128).reshape(16, 8))))
        family = min((of_band[b] for b in bands if b in of_band), default=len(out))
        if family == len(out):
            out.append(set())
        out[family].update(same.setdefault(u, u) for u in units)
        of_band.update(dict.fromkeys(bands, family))
    return out


class Pieces:
    """Pieces of the units that tell toxic texts from clean ones, with the toxic texts that hold them. Texts are
    sets of units."""

    def __init__(self, toxic: list[set[bytes]], clean: list[set[bytes]]):
        self.n_toxic, self.n_clean = len(toxic), len(clean)
        own: dict[bytes, list[int]] = defaultdict(list)
        for i, t in enumerate(toxic):
            for u in t:
                own[u].append(i)
        self.other: Counter[bytes] = Counter()
        for t in clean:
            self.other.update(t)
        #: The texts of the units that no landmark covers yet.
        self.left = {u: n for u, n in own.items() if len(n) >= 2 and self.other[u] * len(toxic) <= 0.02 * len(n) * len(clean)}
        self.covers: dict[bytes, list[bytes]] = defaultdict(list)
        for u in self.left:
            for p in set(pieces(u)):
                self.covers[p].append(u)
        self.everything = b" " + b" ".join(self.other) + b" "

    def texts(self, p: bytes) -> int:
        """In how many toxic texts the units that ``p`` newly covers stand."""
        return len(set().union(*(self.left.get(u, ()) for u in self.covers[p])))

    def is_rare(self, p: bytes, texts: int) -> bool:
        """Whether the share of clean texts that have ``p`` in a unit is at most a hundredth of that of toxic ones."""
        n, enough, at = 0, 0.01 * texts / self.n_toxic * self.n_clean, self.everything.find(p)
        while at >= 0 and n <= enough:
            end = self.everything.index(b" ", at)
            n += self.other[self.everything[self.everything.rindex(b" ", 0, at) + 1 : end]]
            at = self.everything.find(p, end)
        return n <= enough

    def noise(self) -> int:
        """The most texts of a piece that could be a landmark."""
        for texts, p in sorted(((self.texts(p), p) for p in self.covers), reverse=True):
            if self.is_rare(p, texts):
                return texts
        return 0


def choose_landmarks(toxic: list[bytes], clean: list[bytes], most: int = MAX_LANDMARKS) -> list[bytes]:
    """Greedy cover of the units that tell toxic texts from clean ones by pieces of them: each time the piece with the
    largest product of the texts of the units that it newly covers and its length beyond two. Near copies count once.
    A piece needs three texts, and more than any piece has by chance: than the best one that tells a part of the clean
    texts from the others, dealt at random in the proportion of toxic to clean."""
    toxic, clean = families(toxic), families(clean)
    dealt = np.random.default_rng(0).permutation(len(clean)).tolist()
    part = len(clean) * len(toxic) // (len(toxic) + len(clean))
    least = 3
    if 0 < part < len(clean):
        least = max(least, 1 + Pieces([clean[i] for i in dealt[:part]], [clean[i] for i in dealt[part:]]).noise())
    found = Pieces(toxic, clean)
    out: list[bytes] = []
    gains = {p: g * (len(p) - 2) for p in found.covers if (g := found.texts(p)) >= least}
    while len(out) < most and gains:
        best = max(gains, key=lambda p: (gains[p], len(p), p))
        # gains only fall, so a piece whose renewed gain is still the largest is the best
        texts = found.texts(best)
        if texts < least:
            del gains[best]
        elif texts * (len(best) - 2) < gains[best]:
            gains[best] = texts * (len(best) - 2)
        else:
            del gains[best]
            if found.is_rare(best, texts):
                out.append(best)
                for u in found.covers[best]:
                    found.left.pop(u, None)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge and weights ``c`` of the rows, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    ridge = np.diag(np.r_[np.ones(x.shape[1]), 1e-3])
    w = np.zeros(a.shape[1])
    loss = lambda w: w @ ridge @ w / 2 + (c * np.maximum(0, 1 - y * (a @ w)) ** 2).sum()
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (a @ w))
        on = short > 0
        grad = ridge @ w - 2 * (a * (c * y * short)[:, None]).sum(axis=0)
        step = np.linalg.solve(ridge + 2 * (a[on] * c[on, None]).T @ a[on], grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic function, with Platt's smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.c_[margin, np.ones(len(margin))]
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (p - target) + 1e-6 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(toxic: list[bytes], clean: list[bytes]) -> Model:
    """A model of the texts of both kinds."""
    share = len(toxic) / (len(toxic) + len(clean)) if toxic else 0.0
    landmarks = choose_landmarks(toxic, clean) if toxic and clean else []
    give_back()
    if not landmarks:
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    kernel, weights, bias, used = fit(landmarks, toxic, clean)
    if 0 < len(used) < len(landmarks):  # the others told the sample apart by chance
        kernel, weights, bias, _ = fit(used, toxic, clean)
    model = Model(kernel.landmarks, weights, bias, 1.0, 0.0)
    give_back()
    reader = model.reader()
    margin = np.concatenate([model.margins(ts[i : i + 200], reader) for ts in (toxic, clean) for i in range(0, len(ts), 200)])
    model.slope, model.offset = fit_logistic(margin, np.r_[np.ones(len(toxic)), -np.ones(len(clean))])
    return model


def fit(landmarks: list[bytes], toxic: list[bytes], clean: list[bytes]) -> tuple[Kernel, np.ndarray, float, list[bytes]]:
    """The kernel, weights and bias of the machine, and the landmarks to which a toxic text's units respond most, in more texts
    than one."""
    kernel = Kernel(landmarks)
    value, vector = np.linalg.eigh(kernel.matrix())
    whiten, rng = vector / np.sqrt(np.maximum(value, 1e-2)), np.random.default_rng(0)
    x0, n0, _, _ = unit_rows(kernel, clean)
    x1, _, bags, units = unit_rows(kernel, toxic)
    margin = x1.max(axis=1) - RESPONSE
    for _ in range(ROUNDS):
        chosen, n1 = np.unique(np.concatenate([bag[(margin[bag] > 0) | (margin[bag] == margin[bag].max())] for bag in bags]), return_counts=True)
        variants = [(v, n) for i, n in zip(chosen.tolist(), n1.tolist(), strict=True) if n >= 3 for v in distorted(units[i], rng)]
        virtual, n2 = kernel.values([v for v, _ in variants]), np.array([n for _, n in variants], float)
        x = np.concatenate([x0, x1[chosen], virtual])
        y = np.r_[-np.ones(len(x0)), np.ones(len(chosen) + len(virtual))]
        c = np.r_[n0 / n0.sum() * CLEAN, n1 / n1.sum(), n2 / max(1, n2.sum()) * VIRTUAL] * len(toxic)
        w, bias = fit_svm(x @ whiten, y, c)
        weights = whiten @ w
        margin = x1 @ weights + bias
    responds = np.bincount(x1[chosen].argmax(axis=1), np.where(margin[chosen] > 0, n1, 0), minlength=len(landmarks))
    return kernel, weights, bias, [z for z, n in zip(kernel.landmarks, responds.tolist(), strict=True) if n >= 2]


def unit_rows(kernel: Kernel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[bytes]]:
    """The distinct rows of values (to two digits) of the texts' units, how many units have each, the rows of each text, and
    the first unit of each row."""
    known, count, rows, bags, units_of_rows = Units(), Counter(), Units(), [], []
    at: list[int] = []
    for i in range(0, len(texts), 200):
        split = [units_of(t) for t in texts[i : i + 200]]
        new = [u for u in dict.fromkeys(u for units in split for u in units) if u not in known]
        for j in range(0, len(new), SLICE):
            bare = [u.translate(None, _MARKS) for u in new[j : j + SLICE]]
            for u, v in zip(bare, np.round(kernel.values(bare), 2), strict=True):
                at.append(rows[v.tobytes()])
                if len(rows) > len(units_of_rows):
                    units_of_rows.append(u)
            for u in new[j : j + SLICE]:
                known[u]
        for units in split:
            own = [at[known[u]] for u in units]
            count.update(own)
            bags.append(np.unique(own))
    table = np.frombuffer(b"".join(rows), np.float32).reshape(-1, len(kernel.landmarks)).astype(np.float64)
    return table, np.array([count[i] for i in range(len(table))], float), [b for b in bags if len(b)], units_of_rows


def distorted(z: bytes, rng: np.random.Generator) -> set[bytes]:
    """``z`` whole, and with a letter put in, dropped, changed or swapped with the next at each place inside."""
    letter = lambda: bytes([int(rng.integers(97, 123))])
    out = {z}
    for i in range(1, len(z)):
        out |= {z[:i] + letter() + z[i:], z[: i - 1] + z[i : i + 1] + z[i - 1 : i] + z[i + 1 :]}
        if i < len(z) - 1:
            out |= {z[:i] + z[i + 1 :], z[:i] + letter() + z[i + 1 :]}
    return out


def held_out() -> Column:
    """Whether a row is of the fifth whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], list[bytes]]:
    """The training texts: bounded samples of the labelled rows outside the held-out fifth, of texts of a bounded size."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.octet_length("text") <= max_bytes)
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    # max_toxic + max_clean ids at most: a bounded broadcast
    rows = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).collect()
    texts = lambda y: sorted(r["text"].encode() for r in rows if r["toxic"] == y)
    return texts(1), texts(0)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``: 0 to 1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        own = shared.value
        reader = own.reader()
        return lambda texts: pa.array(own.scores(list(byte_values(texts)), reader), pa.float64())

    return docs.withColumn("toxicity", arrow_column(scorer, "double", F.col(text_col)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(*labelled(docs, labels))
    out = score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
