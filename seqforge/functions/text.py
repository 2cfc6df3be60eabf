"""Parsing and token expressions; all of them are JVM-side Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for the wildcard inside n-gram keys (a private-use character); shown as ``*``.
WILD = "\ue000"


def leading_number(text: Column) -> Column:
    """The number that a text begins with, and 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def split_label(line: Column) -> tuple[Column, Column]:
    """Label text and sequence of a line, cut at its first tab or space; without one, both are the line."""
    parts = F.split(line, "[\t ]", 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), parts[0])


def char_tokens(seq: Column) -> Column:
    """Array of characters without white space."""
    bare = F.regexp_replace(seq, r"\s", "")
    return F.when(F.length(bare) > 0, F.split(bare, "")).otherwise(F.array().cast("array<string>"))


def word_tokens(seq: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(seq, r"\s+"), lambda t: t != "")


def byte_tokens(seq: Column) -> Column:
    """Array of the UTF-8 bytes as two hex digits each."""
    return F.regexp_extract_all(F.hex(F.encode(seq, "UTF-8")), F.lit(".."), F.lit(0))


def symbols(seq: Column, as_bytes: bool) -> Column:
    """A text as its symbols are read: itself, or with each of its UTF-8 bytes as the character of that number (so that n-grams, places
    and sizes count in bytes, in the bytes' order)."""
    return F.decode(F.encode(seq, "UTF-8"), "ISO-8859-1") if as_bytes else seq


def byte_name(gram: Column) -> Column:
    """An n-gram of bytes as hex digits, wildcards as ``**``."""
    return F.array_join(F.transform(F.split(gram, ""), lambda c: F.when(c == WILD, "**").otherwise(F.hex(F.encode(c, "ISO-8859-1")))), "")


def gram_size(gram: Column, words: bool) -> Column:
    """How many tokens and wildcards an n-gram has."""
    if not words:
        return F.length(gram)
    return (F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1).cast("int")


def tokens(seq: Column, words: bool = False) -> Column:
    return word_tokens(seq) if words else char_tokens(seq)


def masks(size: int, total_gap: int = 0, run_gap: int = 0) -> list[tuple[bool, ...]]:
    """Which places of an n-gram are wildcards: never its first or last, at most ``total_gap`` and ``run_gap`` in a row. Masks grow
    place by place within the limits, so none is made that they rule out."""
    held: list[tuple[tuple[bool, ...], int, int]] = [((False,), 0, 0)]
    for _ in range(1, size):
        held = [(m + (w,), n + w, (run + 1) * w) for m, n, run in held for w in (False, True) if n + w <= total_gap and (run + 1) * w <= run_gap]
    return sorted(m for m, _, _ in held if not m[-1])


def gap_limits(total: int, run: int) -> tuple[int, int]:
    """Normalised limits: (0, 0) turns wildcards off, (0, k) leaves the total open, (g, 0) or k > g gives runs of up to g."""
    if total == 0 and run == 0:
        return 0, 0
    if total == 0:
        return 1 << 30, run
    return total, total if run == 0 or run > total else run


def mask_grams(toks: Column, mask: tuple[bool, ...], words: bool, bare_text: Column | None = None) -> Column:
    """All n-grams of one mask in the order of their places, repeats included. ``bare_text``: the tokens as :func:`bare` has
    them, in which a regular expression finds runs of characters much faster than an array is sliced."""
    n, sep = len(mask), " " if words else ""
    if bare_text is not None and not words and not any(mask):
        return F.regexp_extract_all(bare_text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))

    def gram(i: Column) -> Column:
        if not any(mask):
            return F.array_join(F.slice(toks, i, n), sep)
        parts = [F.lit(WILD) if w else F.element_at(toks, i + k) for k, w in enumerate(mask)]
        return F.concat_ws(sep, *parts)

    every = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), gram)
    return F.when(F.size(toks) >= n, every).otherwise(F.array().cast("array<string>"))


def bare(seq: Column, words: bool) -> Column:
    """The text in which :func:`holds` looks: without white space, or words between single spaces."""
    if not words:
        return F.regexp_replace(seq, r"\s", "")
    return F.concat(F.lit(" "), F.array_join(word_tokens(seq), " "), F.lit(" "))


def holds(bare_text: Column, gram: str, words: bool) -> Column:
    """Whether a document holds an n-gram, as a search in its text: no array of n-grams is made."""
    if WILD not in gram:
        return F.contains(bare_text, F.lit(f" {gram} " if words else gram))
    parts = gram.split(" ") if words else list(gram)
    any_token = "[^ ]+" if words else "(?s:.)"
    pattern = (" " if words else "").join(any_token if t == WILD else "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in parts)
    return F.rlike(bare_text, F.lit(f" {pattern} " if words else pattern))


def shown(gram: Column) -> Column:
    return F.replace(gram, F.lit(WILD), F.lit("*"))


def prefixes(gram: str, words: bool) -> list[str]:
    """Proper prefixes of an n-gram that end in a token, shortest first."""
    toks = gram.split(" ") if words else list(gram)
    sep = " " if words else ""
    return [sep.join(toks[:i]) for i in range(1, len(toks)) if toks[i - 1] != WILD]


def without_tail(seq: Column, n: int) -> Column:
    return F.substring(seq, F.lit(1), F.greatest(F.length(seq) - n, F.lit(0)))


def clean_hex_line(line: Column) -> Column:
    """A hex-dump line without its offset, blanks and unknown bytes."""
    return F.translate(F.regexp_replace(F.ltrim(line), r"^\S+\s+", ""), " ?", "")
