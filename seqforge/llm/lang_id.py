"""Language identification by compression with a dictionary for each language.

A language's model is a zstandard raw-content dictionary: text of that language as it stands, with letters alone. A text is
encoded once with each dictionary, in slices of ``SLICE`` bytes that all begin from the dictionary (a long text is else encoded by its own
beginning, whatever the dictionary), and the language whose
encoding is smallest is its language; among equal sizes the one with more learning documents, then the first by name. Where
the smallest size is less than ``MIN_MARGIN`` below the next, in shares of the latter, the answer is marked as rejected.

Learning: the documents of each language are counted over the whole corpus; its dictionary is made of a bounded sample, up to
``PER_LANG`` different texts of at most ``MAX_BYTES`` bytes, chosen by a hash of the text, and cut to ``DICT_BYTES``. Sampling
goes by a threshold on the hash first and copies are merged before they are shuffled, so that neither a large language nor a text with many copies meets
in one task. Predictions look at the text alone, and at all of it.

Defined results: ``und`` with score 0 for a null text, one without any letter, and for every text where nothing could be learned; a
language whose texts have no letters or are all too long is not learned; texts that repeat get a row each; a null id is not held out and
not learned from; an empty table gives no rows; other columns pass through, and those with the names of added ones are replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqforge.llm.text import arrow_column, byte_values, struct_array

#: The sample of a language: texts and bytes of a text; bytes of a dictionary.
PER_LANG, MAX_BYTES, DICT_BYTES = 400, 8000, 1 << 16
#: Of the encoding: zstandard's level, bytes of a slice.
LEVEL, SLICE = 6, 1 << 11
#: Share of the second smallest size by which the smallest must be smaller; bytes that change the odds of a language by a factor of e.
MIN_MARGIN, NATS = 0.02, 2.0
UNKNOWN = "und"
#: Lower-cases A-Z and turns every other ASCII byte that is no letter into a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: bytes) -> bytes:
    """A text's words between single spaces, lower-cased, without ASCII digits and marks."""
    words = text.decode().lower().encode().translate(_LETTERS).split()
    return b" ".join(words) + b" " if words else b""


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    return b"".join(map(letters, texts))[-size:]


class Encoders:
    """Compressors of all languages. ``languages``: name, dictionary and number of documents."""

    def __init__(self, languages: list[tuple[str, bytes, int]]):
        self.names = [name for name, _, _ in sorted(languages, key=lambda x: (-x[2], x[0]))]
        self.compressors = []
        content = {name: raw for name, raw, _ in languages}
        for name in self.names:
            known = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        """Bytes of the text's encoding with each dictionary."""
        bare = letters(text)
        slices = [bare[i : i + SLICE] for i in range(0, len(bare), SLICE)]
        return [sum(len(c.compress(s)) for s in slices) for c in self.compressors]

    def best(self, text: bytes) -> tuple[str, float, float]:
        """The language, its share of the odds, and the margin."""
        sizes = self.sizes(text)
        low, at = min((n, i) for i, n in enumerate(sizes))
        second = min((n for i, n in enumerate(sizes) if i != at), default=None)
        odds = sum(math.exp((low - n) / NATS) for n in sizes)
        return self.names[at], 1 / odds, 1.0 if second is None else (second - low) / max(1, second)


def learnable() -> Column:
    """Rows whose language may be learned from; a third of the ids is held out."""
    return ~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, per_lang: int = PER_LANG, max_bytes: int = MAX_BYTES, dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes, int]]:
    """name, dictionary and number of documents of each language of ``docs`` (lang, text). What comes to the driver is a row and a
    sample for each language."""
    rows = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", "text", F.xxhash64("text").alias("h"))
    short = F.octet_length("text") <= max_bytes
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.when(short, F.col("h"))).alias("texts")).where("texts > 0").collect()
    if not counts:
        return []
    # half as many again as are wanted, for what the estimate and chance take away
    limits = [(r["lang"], min(1.0, 1.5 * per_lang / r["texts"])) for r in counts]
    # a row for each language that is learned
    limits = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, share double"))
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    drawn = rows.where(short).join(limits, "lang").where(unit <= F.col("share")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample: dict[str, list[bytes]] = {}
    for r in drawn.withColumn("place", place).where(F.col("place") <= per_lang).orderBy("lang", "h").select("lang", "text").collect():
        sample.setdefault(r["lang"], []).append(r["text"].encode())
    number = {r["lang"]: r["n"] for r in counts}
    return [(lang, dictionary(texts, dict_bytes), number[lang]) for lang, texts in sample.items()]


def identify(docs: DataFrame, languages: list[tuple[str, bytes, int]], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and rejected (whether the margin is below ``min_margin``)."""
    if not languages:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "margin": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    kind = "struct<name:string,score:double,margin:double>"

    def reader():
        encoders = Encoders(shared.value)

        def read(texts: pa.Array) -> pa.Array:
            names, scores, margins = zip(*(encoders.best(t) for t in byte_values(texts)), strict=True) if len(texts) else ((), (), ())
            return struct_array(name=pa.array(names, pa.string()), score=pa.array(scores, pa.float64()), margin=pa.array(margins, pa.float64()))

        return read

    found, known = arrow_column(reader, kind, F.col(text_col)), has_letter(F.col(text_col))
    out = docs.withColumn("__found", found).withColumns({
        "lang_pred": F.when(known, F.col("__found.name")).otherwise(UNKNOWN),
        "score": F.when(known, F.col("__found.score")).otherwise(0.0),
        "margin": F.when(known, F.col("__found.margin")).otherwise(0.0),
    })
    return out.withColumn("rejected", F.col("margin") < min_margin).drop("__found")


def report(docs: DataFrame) -> DataFrame:
    languages = learn(docs.where(learnable()))
    out = identify(docs.select("doc_id", "text"), languages)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
