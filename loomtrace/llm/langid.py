"""Language identification by compression.

For each language, a zstandard dictionary of raw content is made of a bounded sample of labelled texts.  A text is
lower-cased and compressed whole, piece by piece, with every language's dictionary, and the language of the smallest result
wins.  The margin - by what part the second smallest is larger - is the confidence; below ``margin`` the prediction is
rejected (``accepted`` is false).

The sample: of each language's distinct texts the SAMPLE_ROWS with the smallest hashes, those of at most a
SHORTth of a dictionary first.  Of a text that is learned the first LEARNED characters count (a parameter of the fit; texts that are judged are
always whole).  A dictionary holds texts in this order until it is full, so every labelled language is learned, and texts beyond it never leave
the executors.  With more than DICTIONARIES_BYTES / DICTIONARY_BYTES languages the dictionaries get smaller; the driver and the tasks hold
DICTIONARIES_BYTES and a text of each language at most.

Defined cases: null, or text without a letter: lang_pred ``und``, score 0, not accepted; equal sizes: the language with more
distinct labelled texts, then the first by name, score 0; a text with rows of several languages teaches each; no labelled row
at all: ``und`` throughout; repeated rows are judged each on its own and taught once; very long texts are compressed whole;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import arrow_map, cut

#: Bytes of a language's dictionary, and of all dictionaries together.
DICTIONARY_BYTES = 320 << 10
DICTIONARIES_BYTES = 64 << 20
#: Texts of at most this part of a dictionary are sampled first, as many texts teach more than a few long ones.
SHORT = 160
#: Labelled rows of a language that are sampled for its dictionary.
SAMPLE_ROWS = 256
#: Bytes that are compressed together; a text's sizes are the sums over its pieces, so that a long text isn't mainly compressed by itself.
PIECE = 1024
LEVEL = 3
MARGIN = 0.01
#: Characters of a text that are learned.
LEARNED = 40_000
LETTER = re.compile(r"[^\W\d_]")


def held_out(key: str, modulus: int, left: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(modulus)) == left


def sampled(labelled: DataFrame, cap: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """(lang, n (distinct texts of the language), big, h, t; room of a dictionary): the first texts of each language by (longer than ``cap`` bytes, hash), SAMPLE_ROWS at most, until a dictionary is full.

    Hashes are made distinct and ranked in salted groups before texts are looked at, so neither many copies of a text nor
    one frequent language meet in one task, and only the sample's texts go on."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    rows = rows.select(
        F.col(lang).alias("lang"),
        F.xxhash64(text).alias("h"),
        (F.octet_length(text) > cap).alias("big"),
        F.substring(text, 1, LEARNED).alias("t"),
    )
    keys = rows.select("lang", "h", "big").distinct()
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(16))).orderBy("big", "h")
    every = Window.partitionBy("lang").orderBy("big", "h")
    few = keys.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= SAMPLE_ROWS)
    few = few.withColumn("r", F.row_number().over(every)).where(F.col("r") <= SAMPLE_ROWS).select("lang", "h")
    counts = cut(counts)
    room = min(DICTIONARY_BYTES, DICTIONARIES_BYTES // max(1, counts.count()))
    picked = rows.join(F.broadcast(few), ["lang", "h"])  # SAMPLE_ROWS keys of each language
    once = picked.groupBy("lang", "h", "big").agg(F.min("t").alias("t"))
    before = F.sum(F.octet_length("t") + 1).over(Window.partitionBy("lang").orderBy("big", "h").rowsBetween(Window.unboundedPreceding, -1))
    once = once.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < room)  # a language's sample is bounded
    return once.join(counts, "lang").select("lang", "n", "big", "h", "t"), room


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary), those of most distinct texts first."""
    by: dict[str, list] = {}
    counts: dict[str, int] = {}
    rows, room = sampled(labelled, DICTIONARY_BYTES // SHORT, text, lang)
    for r in rows.toLocalIterator():
        counts[r.lang] = r.n
        by.setdefault(r.lang, []).append((r.big, r.h, r.t.lower().encode("utf-8", "replace")))
    return [(name, dictionary([t for _, _, t in sorted(by[name])], room)) for name in sorted(by, key=lambda x: (-counts[x], x))]


def dictionary(texts: list[bytes], room: int) -> bytes:
    """Texts in their order until the room is full, the last one as far as it fits; the first is nearest to what is compressed."""
    got, size = [], 0
    for t in texts:
        t = t[: max(0, room - size)]
        if t:
            got.append(t)
            size += len(t) + 1
    out = b"\n".join(reversed(got))
    return out * (8 // len(out) + 1) if len(out) < 8 else out  # zstandard wants 8 bytes


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL):
        import zstandard

        self.names = [n for n, _ in dictionaries]
        parameters = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_content_size=0, write_dict_id=0)
        self.use = []
        for _, d in dictionaries:
            raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=parameters)
            self.use.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters))

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, accepted)"""
        if not text or not self.use or not LETTER.search(text):
            return "und", 0.0, False
        raw = text.lower().encode("utf-8", "replace")
        sizes = [sum(len(c.compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE)) for c in self.use]
        best = int(np.argmin(sizes))  # the first of equals
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        second = min(s for i, s in enumerate(sizes) if i != best)
        gap = (second - sizes[best]) / second
        return self.names[best], float(gap), gap >= margin


def classify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], key: str = "doc_id", text: str = "text", extra: tuple = (), margin: float = MARGIN) -> DataFrame:
    """key, extra columns, lang_pred, score, accepted.  The dictionaries go to the tasks: about DICTIONARIES_BYTES at most."""
    src = docs.select(key, text, *extra)
    columns = [c for c in src.columns if c != text]
    schema = ", ".join(f"`{c}` {t}" for c, t in src.dtypes if c != text) + ", lang_pred string, score double, accepted boolean"

    def work(batches):
        use = Classifier(dictionaries)
        for batch in batches:
            got = [use.predict(t, margin) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in columns] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                [*columns, "lang_pred", "score", "accepted"],
            )

    return arrow_map(src, work, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; learned from rows that are not held out (crc32 of doc_id modulo 4 is not 2)."""
    out = held_out("doc_id", 4, 2)
    return classify(docs, fit(docs.where(~out).select("text", "lang")), extra=(out.alias("held_out"),))
