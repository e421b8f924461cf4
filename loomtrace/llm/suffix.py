"""Removal of long repeated byte strings, decided by suffixes sorted with a difference cover.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier (smaller document, or the same document
and an earlier start).  So for every start of such a string it must be known whether its LENGTH-byte prefix is the first
of its kind.  Suffixes are dealt to tasks by content, so that equal prefixes meet, and each task sorts its own:

1. Anchors.  In every window of LENGTH bytes the smallest hash of ANCHOR consecutive bytes (leftmost of equals) is its
   anchor, so equal windows have equal anchors at equal places.  Neighbouring windows of one anchor are a run.  Each part of
   the documents tells its distinct anchors, each once; a window whose anchor occurs once in the corpus has no equal.
2. Each part hears which of its anchors occur again, cuts the texts of their runs from its documents and deals them by
   anchor.  Equal texts within a slice are compared and go on once.  Anchors with more than BIG different runs are dealt
   by the hash of each window instead, so that no task's share grows with one passage.  Hashes only route.
3. Each task sorts its runs' texts; of adjacent equal ones all but the earliest are repeats.  Where an anchor has different
   texts, their suffixes are sorted by a difference cover modulo 3 - sample suffixes by their triples' names, recursion on
   the names (until they span LENGTH bytes), the other suffixes by one symbol and a sample rank, and a merge - and adjacent
   LENGTH-byte prefixes are compared: of each group of equal ones all but the earliest are repeats.
4. A document's spans are merged and cut from its bytes.

The documents are shuffled once; that exchange serves steps 1, 2 and 4.  All decisions compare bytes.

Defined cases: null is the empty text; null keys come before all others and stay null; rows of one key are ordered by a hash
of their text; of rows equal in key and text one is the first and the others repeat it; texts of any length are held whole;
empty tables give empty results; further columns are ignored or, by drop_repeats, kept.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .session import arrow_map, fanout

LENGTH = 100
ANCHOR = 32
#: Different runs of one anchor beyond which they are dealt by window.
BIG = 4000
#: Text bytes whose runs are found, and whose equal runs are combined, at once.
PART_BYTES = 16 << 20
#: Bytes that are sorted together; ranks stay below 2**21, so three of them fit one 64-bit key.
SORT_BYTES = 1 << 20
U = np.uint64
PLACE = (1 << 20) - 1
NO_KEY = -(1 << 63)


# --- suffix order -----------------------------------------------------------------------------------------------------


def difference_cover_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix order of a text of integers in [1, 2**21), right for prefixes of ``depth`` symbols at least.  Suffixes of equal prefixes may be in any order."""
    n = len(text)
    if n < 3:
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        return np.array(order, np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = text
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    key = (t[sample] << 42) | (t[sample + 1] << 21) | t[np.minimum(sample + 2, n + 2)]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    name = np.empty(len(sample), np.int64)
    name[order] = np.concatenate(([1], 1 + np.cumsum(ranked[1:] != ranked[:-1])))
    if depth > 3 and name[order[-1]] < len(sample):
        inner = difference_cover_order(name, -(-depth // 3))
        name[inner] = np.arange(1, len(sample) + 1)
    else:
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    sorted_sample = sample[np.argsort(name, kind="stable")]
    sorted_sample = sorted_sample[sorted_sample < n]
    third = np.arange(0, n, 3)
    k0 = (t[third] << 21) | rank[third + 1]
    third = third[np.argsort(k0, kind="stable")]
    is_one = sorted_sample % 3 == 1
    s1, s2 = sorted_sample[is_one], sorted_sample[~is_one]
    # suffixes that agree in ``depth`` symbols have any order, so that keys may step back among them; running maxima keep them together
    k1 = np.maximum.accumulate((t[s1] << 21) | rank[s1 + 1])
    k2 = np.maximum.accumulate((t[s2] << 42) | (t[s2 + 1] << 21) | rank[s2 + 2])
    below = np.searchsorted(k1, (t[third] << 21) | rank[third + 1]) + np.searchsorted(
        k2,
        (t[third] << 42) | (t[third + 1] << 21) | rank[third + 2],
    )
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(below) + np.arange(len(third))
    out[at] = third
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sorted_sample
    return out


def later_windows(texts: list[bytes], order_key: np.ndarray, length: int) -> np.ndarray:
    """Of the concatenated texts' places: True where a window of ``length`` bytes within a text starts that an earlier start (by the texts' order_key, then by place) has too."""
    sizes = np.array([len(x) for x in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = np.arange(n) <= (start + sizes - length)[owner]
    order = difference_cover_order(raw.astype(np.int64) + 1, length)
    order = order[valid[order]]
    later = np.zeros(n, bool)
    if len(order) < 2:
        return later
    eight = np.zeros(n + 8, U)
    for i in range(8):
        eight[: max(0, n - i)] |= raw[i:].astype(U) << U(8 * i)
    same = np.ones(len(order) - 1, bool)
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    p, q = order[:-1], order[1:]
    for d in steps:
        same &= eight[p + d] == eight[q + d]
    if length < 8:
        mask = U((1 << (8 * length)) - 1)
        same = (eight[p] & mask) == (eight[q] & mask)
    group = np.concatenate(([0], np.cumsum(~same)))
    rank = order_key[owner[order]] * (n + 1) + (order - start[owner[order]])
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank)
    later[order[rank > least[group]]] = True
    return later


# --- runs -------------------------------------------------------------------------------------------------------------


def runs(raw: np.ndarray, at: np.ndarray, length: int, anchor: int, segment: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """The runs of concatenated texts: anchor hash, digest, first window, windows less one, the anchor's place in the first window."""
    wide = length - anchor + 1
    n, out = len(raw), []
    for s in range(0, max(0, n - length + 1), segment):
        e = min(n, s + segment)
        part = raw[s : min(n, e + length - 1)]
        m = len(part)
        p, q = kernels.powers(m + 1)
        c = np.zeros(m + 1, U)
        np.cumsum((part.astype(U) + U(1)) * p[:-1], out=c[1:])
        h = kernels.mix((c[anchor:] - c[:-anchor]) * q[: m + 1 - anchor])
        x = (h & ~U(PLACE)) | np.arange(len(h), dtype=U)
        span = 1
        while span * 2 <= wide:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        if wide > span:
            x = np.minimum(x[: span - wide], x[wide - span :])
        place = (x[: e - s] & U(PLACE)).astype(np.int64)
        k = len(place)
        valid = np.zeros(k + 1, np.int32)
        lo, hi = max(0, int(np.searchsorted(at, s, "right")) - 1), int(np.searchsorted(at, s + k, "left"))
        a = np.maximum(at[lo:hi], s) - s
        b = np.minimum(at[lo + 1 : hi + 1] - length + 1, s + k) - s
        some = b > a
        np.add.at(valid, a[some], 1)
        np.add.at(valid, b[some], -1)
        valid = np.cumsum(valid[:-1]) > 0
        first, last = valid.copy(), valid.copy()
        step = place[1:] == place[:-1]
        first[1:] &= ~(valid[:-1] & step)
        last[:-1] &= ~(valid[1:] & step)
        i, j = np.flatnonzero(first), np.flatnonzero(last)
        where = place[i] - i
        digest = kernels.mix((c[j + length] - c[i]) * q[i] + where.astype(U) * U(kernels.BASE) + (j - i).astype(U) * U(0xC2B2AE3D27D4EB4F))
        out.append((h[place[i]], digest, i + s, j - i, where))
    if not out:
        return np.empty(0, U), np.empty(0, U), *[np.empty(0, np.int64)] * 3
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


#: What tasks send: to task b, a payload; ``done`` payloads are repeats already.
PARTS = "b int, done boolean, payload binary"
#: Spans of a document (its key, its text's hash, its number among texts of that hash): start and stop in turn.
NOTES = "k bigint, h bigint, u int, spans array<bigint>"
NOTES_ARROW = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("u", pa.int32()), ("spans", pa.list_(pa.int64()))])


def packed(columns: list[tuple[np.ndarray, type]]) -> bytes:
    """Columns of equal length in one payload."""
    return struct.pack("<q", len(columns[0][0])) + b"".join(c.astype(t).tobytes() for c, t in columns)


def unpacked(x: bytes, types: tuple) -> tuple[list[np.ndarray], int]:
    """The columns of a payload and where it goes on."""
    (n,) = struct.unpack_from("<q", x)
    at, out = 8, []
    for t in types:
        out.append(np.frombuffer(x, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, at


def part_batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())],
        ["b", "done", "payload"],
    )


def notes(key: np.ndarray, h: np.ndarray, u: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """A row for each document: its spans in one list.  The input is sorted here."""
    order = np.lexsort((start, u, h, key))
    key, h, u = key[order], h[order], u[order]
    cut = np.ones(len(key), bool)
    cut[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (u[1:] != u[:-1])
    at = np.flatnonzero(cut)
    ends = pa.array((np.append(at, len(key)) * 2).astype(np.int32))
    values = np.stack((start[order], stop[order]), 1).astype(np.int64).reshape(-1)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[at]), pa.array(h[at]), pa.array(u[at].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(values))],
        schema=NOTES_ARROW,
    )


def slices(batch: pa.RecordBatch, column: int, size: int):
    """(rows from, to, bytes, offsets) of consecutive rows with about ``size`` bytes of text."""
    raw, at = kernels.flat(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


# step 1: anchor, different runs, whether it occurs twice; its answer: anchor, whether it is dealt by window
ASK, ANSWER = (U, np.uint16, bool), (U, bool)


def find_anchors(buckets: int, length: int, anchor: int):
    """Rows (b, k, h, payload): a part's distinct anchors, in the name of its first document."""

    def find(batches):
        first, seen = None, []
        for batch in batches:
            if first is None and batch.num_rows:
                first = [batch.column(i)[0].as_py() for i in (0, 1)]
            for _, _, raw, at in slices(batch, 3, PART_BYTES):
                h, digest, *_ = runs(raw, at, length, anchor)
                seen.append(np.stack((h, digest)))
        if first is None:
            return
        h, digest = np.concatenate(seen, 1)
        seen.clear()
        order = np.lexsort((digest, h))
        h, digest = h[order], digest[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= digest[1:] != digest[:-1]
        kinds = np.minimum(np.add.reduceat(other.astype(np.int64), at), 65535) if len(at) else at
        twice = np.diff(np.append(at, len(h))) > 1
        bucket = (h[at] % U(buckets)).astype(np.int64)
        sort = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[sort], prepend=-1))
        rows = []
        for x, y in zip(cuts, np.append(cuts[1:], len(sort)), strict=True):
            take = sort[x:y]
            rows.append((int(bucket[take[0]]), packed([(h[at][take], ASK[0]), (kinds[take], ASK[1]), (twice[take], ASK[2])])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([first[0]] * len(rows), pa.int64()), pa.array([first[1]] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            ["b", "k", "h", "payload"],
        )

    return find


def answer(most: int):
    """Rows (k, h, payload): those of each part's anchors that occur again, and whether they have more than ``most`` different runs."""

    def work(batches):
        names, asked = [], []
        for batch in batches:
            names += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            asked += [unpacked(x, ASK)[0] for x in batch.column(3).to_pylist()]
        if not names:
            return
        every, code = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        kinds = np.bincount(code, np.concatenate([a[1] for a in asked]))
        times = np.bincount(code, np.concatenate([a[2] for a in asked]) + 1.0)
        again, often = times > 1, kinds > most
        at, out = 0, []
        for a in asked:
            own = code[at : at + len(a[0])]
            at += len(a[0])
            take = again[own]
            out.append(packed([(a[0][take], ANSWER[0]), (often[own][take], ANSWER[1])]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in names], pa.int64()), pa.array([h for _, h in names], pa.int64()), pa.array(out, pa.binary())],
            ["k", "h", "payload"],
        )

    return work


# step 2: route, key, hash, number, start, size; then the texts
TEXTS = (U, np.int64, np.int64, np.int32, np.int64, np.int64)


def cut_texts(buckets: int, length: int, anchor: int):
    """Rows (b, done, payload) with the texts of the runs whose anchors occur again."""

    def pack(rows):
        route, owner, text = zip(*rows, strict=True)
        k, h, u, start = (np.array(x) for x in zip(*owner, strict=True))
        head = packed([(np.array(route, U), U), (k, np.int64), (h, np.int64), (u, np.int32), (start, np.int64), (np.array([len(x) for x in text]), np.int64)])
        return head + zstandard.ZstdCompressor(level=1).compress(b"".join(text))

    def cut(batches):
        known = None
        for batch in batches:
            if known is None and batch.num_rows:
                answers = batch.column(4)[0].as_py()
                if answers is None:
                    raise RuntimeError("the documents are not dealt as they were when their anchors were found")
                got = [unpacked(x, ANSWER)[0] for x in answers]
                again, often = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                order = np.argsort(again)
                known = again[order], often[order]
            for i, j, raw, at in slices(batch, 3, PART_BYTES):
                h, _, start, more, _ = runs(raw, at, length, anchor)
                place = np.minimum(np.searchsorted(known[0], h), max(0, len(known[0]) - 1))
                take = np.flatnonzero(known[0][place] == h) if len(known[0]) else np.empty(0, np.int64)
                if not len(take):
                    continue
                row = np.searchsorted(at, start[take], "right") - 1
                own = list(zip(
                    *[batch.column(c).slice(i, j - i).to_numpy()[row].tolist() for c in (0, 1, 2)],
                    (start[take] - at[row]).tolist(),
                    strict=True,
                ))
                text = raw.tobytes()
                first: dict[tuple, tuple] = {}
                done = []  # documents and places ascend, so the first owner of a text is the earliest
                for a, owner, s, m, w in zip(
                    h[take].tolist(),
                    own,
                    start[take].tolist(),
                    more[take].tolist(),
                    known[1][place[take]].tolist(),
                    strict=True,
                ):
                    if not w:
                        piece = text[s : s + m + length]
                        if first.setdefault((a, piece), owner) is not owner:
                            done.append((*owner, m + length))
                        continue
                    for d in range(m + 1):
                        piece = text[s + d : s + d + length]
                        owner_d = (*owner[:3], owner[3] + d)
                        if first.setdefault(
                            (int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little"), piece),
                            owner_d,
                        ) is not owner_d:
                            done.append((*owner_d, length))
                by: dict[int, list] = {}
                for (route, piece), owner in first.items():
                    by.setdefault(route % buckets, []).append((route, owner, piece))
                rows = [(b, False, pack(x)) for b, x in by.items()]
                if done:
                    k, hh, u, s, size = (np.array(x) for x in zip(*done, strict=True))
                    rows.append((int(h[take[0]] % U(buckets)), True, packed([(np.zeros(len(k)), U), (k, np.int64), (hh, np.int64), (u, np.int32), (s, np.int64), (size, np.int64)])))
                yield part_batch(rows)

    return cut


def sort_texts(length: int):
    """Step 3: the spans of repeated windows."""

    def windows(rank, texts):
        """(text, start, stop) of the repeated windows of one share of whole routes' different texts."""
        later = later_windows(texts, rank, length)
        at = np.flatnonzero(later)
        if not len(at):
            return at, at, at
        sizes = np.array([len(x) for x in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        own = np.searchsorted(base, at, "right") - 1
        begin = np.ones(len(at), bool)
        begin[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
        i = np.flatnonzero(begin)
        j = np.append(i[1:], len(at)) - 1
        start = at[i] - base[own[i]]
        return own[i], start, start + at[j] - at[i] + length

    def work(batches):
        held: list[bytes] = []
        for batch in batches:
            for done, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if done:
                    (_, k, h, u, start, size), _ = unpacked(x, TEXTS)
                    yield notes(k, h, u, start, start + size)
                else:
                    held.append(x)
        if not held:
            return
        columns, texts = [], []
        for x in held:
            got, at = unpacked(x, TEXTS)
            columns.append(got)
            every, at = zstandard.decompress(x[at:]), 0
            for n in got[5].tolist():
                texts.append(every[at : at + n])
                at += n
        held.clear()
        route, k, h, u, start, size = (np.concatenate(c) for c in zip(*columns, strict=True))
        columns.clear()
        # by route, then text; of equal ones the earliest first
        rows = np.lexsort((start, u, h, k)).tolist()
        rank = np.unique(route, return_inverse=True)[1].tolist()
        rows.sort(key=lambda i: (rank[i], texts[i]))
        order = np.array(rows)
        same = np.array([False, *(rank[x] == rank[y] and texts[x] == texts[y] for x, y in zip(rows, rows[1:], strict=False))])
        if same.any():
            x = order[same]
            yield notes(k[x], h[x], u[x], start[x], start[x] + size[x])
        order = order[~same]
        route = route[order]
        one = np.ones(len(order), bool)
        one[1:] = route[1:] != route[:-1]
        group = np.cumsum(one) - 1
        order = order[np.bincount(group)[group] > 1]
        group = group[np.bincount(group)[group] > 1]
        if not len(order):
            return
        k, h, u, start, size = k[order], h[order], u[order], start[order], size[order]
        texts = [texts[i] for i in order.tolist()]
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        ends = np.concatenate(([0], np.cumsum(size)))
        i = 0
        while i < len(cuts) - 1:
            j = max(i + 1, int(np.searchsorted(ends[cuts], ends[cuts[i]] + SORT_BYTES, "right")) - 1)
            a, b = cuts[i], cuts[j]
            rank = np.empty(b - a, np.int64)
            rank[np.lexsort((start[a:b], u[a:b], h[a:b], k[a:b]))] = np.arange(b - a)
            own, x, y = windows(rank, texts[a:b])
            if len(own):
                own = own + a
                yield notes(k[own], h[own], u[own], start[own] + x, start[own] + y)
            i = j

    return work


# --- documents --------------------------------------------------------------------------------------------------------


def covered(n: int, lists: list) -> np.ndarray:
    """Which of n bytes lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    for x in lists:
        if x:
            v = np.array(x, np.int64)
            np.add.at(edge, v[0::2], 1)
            np.add.at(edge, v[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, length: int, anchor: int, rest: list[str]) -> DataFrame:
    """__k, __u, __again (equal to an earlier row in key and text), __t, __rest, spans (a list of (u, spans))."""
    parts = fanout(docs)
    t = F.coalesce("text", F.lit(""))
    src = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_KEY)).alias("__k"),
        t.alias("__t"),
        F.struct(F.col("text").isNull().alias("__null"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("__rest"),
    )
    # texts without a window take no part and are dealt by their row; so many equal ones don't meet
    short = F.octet_length("__t") < length
    src = src.withColumn("__h", F.when(short, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("__t")))
    w = Window.partitionBy("__k", "__h").orderBy("__t")
    dealt = (
        src.repartition(parts, "__k", "__h")
        .withColumn("__u", F.dense_rank().over(w))
        .withColumn("__again", F.coalesce(F.lag("__t").over(w) == F.col("__t"), F.lit(False)))
    )
    # with __rest, so that all steps read one exchange
    live = dealt.where(~F.col("__again") & ~short).select("__k", "__h", "__u", "__t", "__rest")
    asked = arrow_map(live, find_anchors(parts, length, anchor), "b int, k bigint, h bigint, payload binary").repartitionById(parts, "b")
    answers = arrow_map(asked, answer(BIG), "k bigint, h bigint, payload binary")
    answers = answers.groupBy(F.col("k").alias("__k"), F.col("h").alias("__h")).agg(F.collect_list("payload").alias("answers"))  # one row for each part
    joined = live.join(answers, ["__k", "__h"], "left").select("__k", "__h", "__u", "__t", "answers", "__rest")
    texts = arrow_map(joined, cut_texts(parts, length, anchor), PARTS).repartitionById(parts, "b")
    found = arrow_map(texts, sort_texts(length), NOTES)
    found = found.groupBy(F.col("k").alias("__k"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("u", "spans")).alias("spans"))  # of one text
    return dealt.join(found, ["__k", "__h"], "left").select("__k", "__u", "__again", "__t", "__rest", "spans")


def spans_of(batch: pa.RecordBatch, length: int) -> list[tuple[bytes, np.ndarray | None]]:
    """Each row's bytes and which of them go; None if none do."""
    out = []
    for u, again, text, spans in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3, 5)], strict=True):
        raw = text.encode()
        if again and len(raw) >= length:
            out.append((raw, np.ones(len(raw), bool)))
        else:
            own = [x["spans"] for x in spans or () if x["u"] == u]
            out.append((raw, covered(len(raw), own) if own else None))
    return out


def repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def judge(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for raw, c in spans_of(batch, length):
                gone, spans, kept = 0, 0, raw
                if c is not None:
                    gone, spans = int(c.sum()), int(c[0]) + int(np.count_nonzero(c[1:] & ~c[:-1]))
                    kept = np.frombuffer(raw, np.uint8)[~c].tobytes()
                for o, v in zip(out, (len(raw), gone, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    o.append(v)
            key = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, mask=key == NO_KEY), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return arrow_map(
        _with_spans(docs, length, anchor, []),
        judge,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs with the repeated bytes cut from the texts and n_chars counted anew.  Of a character that is covered in part, all bytes stay."""
    rest = [c for c in docs.columns if c != "text"]

    def cut(batches):
        for batch in batches:
            texts = []
            for data, c in spans_of(batch, length):
                if c is not None:
                    raw = np.frombuffer(data, np.uint8)
                    lead = np.flatnonzero((raw & 0xC0) != 0x80)
                    whole = np.repeat(np.logical_and.reduceat(c, lead), np.diff(np.append(lead, len(raw))))
                    data = raw[~whole].tobytes()
                texts.append(data.decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(4)], ["__t", "__rest"])

    spans = _with_spans(docs, length, anchor, rest)
    kind = spans.schema["__rest"].dataType.simpleString()
    got = arrow_map(spans, cut, f"__t string, __rest {kind}")
    text = F.when(F.col("__rest.__null"), F.lit(None)).otherwise(F.col("__t"))
    columns = {c: F.col(f"__rest.c{i}") for i, c in enumerate(rest)} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(text.isNull(), columns["n_chars"]).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return got.select(*[columns[c].alias(c) for c in docs.columns])


#: repeated_bytes(docs).
ORACLE = f"""
WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
wins AS (
  SELECT doc_id, p, CAST(doc_id AS HUGEINT) * 1099511627776 + p AS place, x[p + 1 : p + {LENGTH}] AS w
  FROM (SELECT doc_id, x, unnest(generate_series(0, octet_length(x) - {LENGTH})) AS p FROM h WHERE octet_length(x) >= {LENGTH})),
later AS (SELECT doc_id, p FROM wins WHERE place NOT IN (SELECT min(place) FROM wins GROUP BY w)),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH}, true) AS fresh FROM later),
numbered AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM marked),
spans AS (SELECT doc_id, s, min(p) AS start, max(p) + {LENGTH} AS stop FROM numbered GROUP BY doc_id, s),
gaps AS (SELECT doc_id, s, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY s), 0) AS free FROM spans),
cut AS (
  SELECT doc_id, sum(stop - start) AS gone, count(*) AS spans, max(stop) AS tail, string_agg(hex(x[free + 1 : start]), '' ORDER BY s) AS kept
  FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(x) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(CASE WHEN gone IS NULL THEN x ELSE unhex(kept || hex(x[tail + 1 : octet_length(x)])) END) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""
