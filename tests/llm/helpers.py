"""Small documents with every awkward case, and plain versions of what operators do."""

from __future__ import annotations

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "The quick brown fox jumps over the lazy dog and then does so again, as it did before the war of the roses began in 1455. "
OTHER = "Le vif renard brun saute par dessus le chien paresseux puis recommence encore, comme avant la guerre de cent ans. "
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def awkward() -> list[tuple]:
    texts = [
        (1, PROSE * 4, "en"), (2, PROSE * 4 + "more words at the end", "en"), (3, None, "en"), (4, "", None), (5, " \t\n", "fr"), (6, "a", "en"), (7, "a b", "en"), (8, "A  b", "en"),
        (9, OTHER * 5, "fr"), (10, OTHER * 5, "fr"), (10, OTHER * 5, "fr"), (11, "é" * 150, "fr"), (12, "!!! 123 ???", None), (13, "日本語 テスト 文書", None), (14, "a" * 350, "en"),
        (15, PROSE[:99], "en"), (16, "x y " * 3000 + PROSE, "en"), (17, PROSE.upper(), "en"), (18, "tab\tnew\nline\r\nnul\x00byte", "en"), (19, OTHER + PROSE, "fr"), (20, "one two three four five six seven eight nine ten eleven", "en"),
        (None, PROSE, None), (10**15, "ü w x y z", None), (-5, "🙂 🙂 a", "en"), (21, "word " * 400, "en"),
    ]
    return [(i, t, lang, f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t, lang in texts]


def frame(spark, rows=None, extra: bool = True):
    """The documents, with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if extra:
        for name in ("k", "b", "rep", "bucket", "spans", "score", "items", "kept", "c0", "n_tokens"):
            df = df.withColumn(name, F.lit(name))
    return df


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def rows_of(df, *names):
    key = lambda r: [(v is not None, v) for v in r]
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=key)


def text_place(t) -> int:
    """The place of a text among those of one key: Spark's xxhash64."""
    import numpy as np
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64))


def in_order(rows):
    """(key, text) in the order of operators that look at a document's next or earlier ones: null keys first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_place(r[1]), r[1] or ""))
