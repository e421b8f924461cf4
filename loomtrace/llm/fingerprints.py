"""Document fingerprints: bottom-k sketches of the hashes of five-word shingles.

A sketch is the K smallest distinct 64-bit hashes of a set, ascending.  The sketch of a union is the K smallest of both
sketches' values, so sketches of parts merge in any order.  From them: resemblance (the share of the union's K smallest that
both have), containment, and the number of distinct shingles ((K - 1) / K-th smallest as a part of the range).  Sets of
fewer than K shingles are held whole, and all three figures are then exact.

Defined cases: null text is empty and has the empty sketch, whose string is ""; two empty sketches are alike (1.0), an
empty and another are not (0.0); a text of fewer than five words is one shingle; rows of one key are ordered by a
hash of their text, then text; null keys come first; an only document is its own next one; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .session import OrderedBuckets, arrow_map, fanout

K = 128
SHINGLE = 5
STEP_BYTES = 4 << 20
NO_KEY = -(1 << 63)


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The sketch of each text."""
    raw, at = kernels.flat_texts([t.encode() for t in texts])
    _, _, h, first = kernels.words(raw, at, kernels.SPACE)
    s, s_at = kernels.shingles(h, first, SHINGLE)
    return [np.unique(s[s_at[i] : s_at[i + 1]])[:k] for i in range(len(texts))]


def union(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate((a, b)))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    fresh = np.concatenate(([True], ~twice))
    if fresh.sum() > k:
        twice = twice & (both[1:] <= both[np.flatnonzero(fresh)[k - 1]])
        return float(twice.sum() / k)
    return float(twice.sum() / fresh.sum())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b).mean())
    return float(min(1.0, resemblance(a, b, k) * distinct(union(a, b, k), k) / max(1.0, distinct(a, k))))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint: one sketch a row; no shuffle."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(s) for s in sketches([t or "" for t in batch.column(1).to_pylist()])], pa.string())],
                [key, "fingerprint"],
            )

    src = docs.select(key, text)
    return arrow_map(src, work, f"`{key}` {dict(src.dtypes)[key]}, fingerprint string")


def merged(parts: DataFrame, by: str, sketch: str = "fingerprint", k: int = K) -> DataFrame:
    """by, fingerprint: the sketch of the union of each group's sketches.  The k smallest of a group are kept by a rank that
    is cut in each task before the shuffle (and salted, for large groups), so a group is nowhere gathered whole."""
    src = parts.select(F.col(by).alias("__g"), F.col(sketch).alias("__s"))
    kind = dict(src.dtypes)["__g"]

    def local(batches):
        held: dict = {}
        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = from_text(s or "")
                held[g] = union(held[g], a, k) if g in held else a[:k]
                if len(held) > 20_000:
                    yield made(held)
                    held = {}
        yield made(held)

    def made(held):
        keys, values = [], []
        for g, a in held.items():
            keys += [g] * max(1, len(a))
            values += [int(x) - (1 << 63) for x in a.tolist()] or [None]
        return pa.RecordBatch.from_arrays([pa.array(keys, src_type), pa.array(values, pa.int64())], ["g", "h"])

    from pyspark.sql.pandas.types import to_arrow_type

    src_type = to_arrow_type(src.schema["__g"].dataType)
    few = arrow_map(src, local, f"g {kind}, h bigint").distinct()
    salt = F.pmod(F.hash("h"), F.lit(32))
    few = (
        few.withColumn("s", salt)
        .withColumn("r", F.row_number().over(Window.partitionBy("g", "s").orderBy(F.col("h").asc_nulls_last())))
        .where(F.col("r") <= k)
    )
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("h").asc_nulls_last()))).where(F.col("r") <= k)
    lists = few.groupBy("g").agg(F.array_sort(F.collect_list("h")).alias("h"))

    def joined(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(
                    [to_text(np.array([x + (1 << 63) for x in h], np.uint64)) for h in batch.column(1).to_pylist()],
                    pa.string(),
                )],
                [by, "fingerprint"],
            )

    return arrow_map(lists, joined, f"`{by}` {kind}, fingerprint string")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(b, g, k, t): docs in ordered buckets; each bucket ends with the next bucket's first document (g: true), the last with the first of all.  One shuffle of the texts."""
    k, t = F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)), F.coalesce(text, F.lit(""))
    src = docs.select(k.alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))
    buckets = OrderedBuckets(src, [F.col("k"), F.col("h")], fanout(docs))
    src = src.withColumn("b", buckets.of(F.col("k"), F.col("h")))
    firsts = src.groupBy("b").agg(F.min(F.struct("k", "h")).alias("o"))
    all_ = Window.partitionBy(F.lit(0))  # one row a bucket
    before = F.coalesce(F.lag("b").over(all_.orderBy("b")), F.max("b").over(all_))
    firsts = firsts.select("o.k", "o.h", before.alias("before"))
    rows = src.join(F.broadcast(firsts), ["k", "h"], "left")
    own = F.struct(F.col("b").alias("b"), F.lit(False).alias("g"))
    other = F.struct(F.col("before").alias("b"), F.lit(True).alias("g"))
    places = F.when(F.col("before").isNotNull(), F.array(own, other)).otherwise(F.array(own))
    rows = rows.withColumn("p", F.explode(places)).select("p.b", "p.g", "k", "t", "h")
    return rows.repartitionById(buckets.n, "b").sortWithinPartitions("b", "g", "k", "h", "t").select("b", "g", "k", "t")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles, held_by_edited.

    The edited text is the text whose last quarter of characters is replaced by the first as many of the next document's.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "held_by_edited"]
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, held_by_edited double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def work(batches):
        held = None  # (key, text, sketch) that waits for its next
        ended = False

        def step(keys, texts):
            nonlocal held
            own = sketches(texts)
            rows = ([held] if held else []) + list(zip(keys, texts, own, strict=True))
            held = rows[-1]
            edited = []
            for (_, t, _), (_, after, _) in zip(rows, rows[1:], strict=False):
                q = len(t) // 4
                edited.append(t[: len(t) - q] + after[:q])
            out = [[] for _ in names]
            for (k, t, a), (_, _, b), e, s in zip(rows, rows[1:], edited, sketches(edited), strict=False):
                for o, v in zip(
                    out,
                    (None if k == NO_KEY else k, len(t), hashlib.sha256(e.encode()).hexdigest(), to_text(a), to_text(s), resemblance(a, s), resemblance(a, b), distinct(a), containment(a, s)),
                    strict=True,
                ):
                    o.append(v)
            return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names)

        for batch in batches:
            if ended:
                continue
            ghosts = batch.column(1).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            if ghosts.any():  # the first of them is the last row's next one
                n, ended = int(np.argmax(ghosts)) + 1, True
            keys, texts = batch.column(2).slice(0, n).to_pylist(), batch.column(3).slice(0, n).to_pylist()
            i = 0
            while i < n:
                j, size = i, 0
                while j < n and (j == i or size + len(texts[j]) <= STEP_BYTES):
                    size += len(texts[j])
                    j += 1
                yield step(keys[i:j], texts[i:j])
                i = j

    return arrow_map(with_next(docs), work, schema)
