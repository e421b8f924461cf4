"""Benchmark decontamination with an FM-index per training shard.

A shard is the rows of one Arrow batch.  Its symbols are words.  A window of a benchmark item can only lie within a run of
words that all occur in the benchmark, so the shard's text for the index is those runs that are as long as the shortest
window at least, with one separator symbol between them; nothing else can match.  Over that text the shard builds a
suffix array, its Burrows-Wheeler transform, a wavelet matrix (rank in one step per bit of a symbol) and sampled suffix
positions.  All windows search backward together, one vector step per word; the rows of each hit walk back (LF steps) to
a sampled position, and the occurrences become removal spans, merged per document.

The benchmark is kept in block files of the shared folder, each of bounded size and written by Spark's tasks; a task holds
one block at a time and judges its shards by every block, so that no row's result depends on the number of blocks and
nothing is merged by key.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no window; an item of fewer
words than a window is one window; items of equal text are all counted, rows of one item_id once (a null item_id is "");
repeated and null doc_ids are judged row by row; texts of any length are indexed whole; empty tables give empty results or
no hits; further columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .session import arrow_map, get_file, new_folder, put_file

#: Consecutive words of a window.
WINDOW = 10
#: Text bytes of a block of benchmark items (or one item); bounds a task's memory.
BLOCK_BYTES = 4 << 20
#: Bytes of text that are judged by one block after the other, where there are several.
ROUND_BYTES = 32 << 20
#: Every so many text positions the suffix array is kept.
SAMPLE = 8
#: Text bytes of a shard that are indexed together.
SHARD_BYTES = 8 << 20


class Wavelet:
    """A wavelet matrix over small integers: rank of a symbol before a place, for vectors of symbols and places."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros = [], []
        x = symbols
        for b in range(bits - 1, -1, -1):
            bit = (x >> b) & 1
            c = np.zeros(self.n + 1, np.int64)
            np.cumsum(bit, out=c[1:])
            self.ones.append(c)
            self.zeros.append(self.n - int(c[-1]))
            x = np.concatenate((x[bit == 0], x[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(place), place
        for level in range(self.bits):
            c, z = self.ones[level], self.zeros[level]
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = c[lo], c[hi]
            lo, hi = np.where(one, z + a, lo - a), np.where(one, z + b, hi - b)
        return hi - lo

    def at(self, place: np.ndarray) -> np.ndarray:
        out, i = np.zeros_like(place), place
        for level in range(self.bits):
            c, z = self.ones[level], self.zeros[level]
            one = c[i + 1] - c[i] == 1
            out = out * 2 + one
            i = np.where(one, z + c[i], i - c[i])
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a text of non-negative integers, by doubled ranks."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Counts and places of patterns in a text of symbols >= 1; symbol 0 ends the text."""

    def __init__(self, symbols: np.ndarray):
        text = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_order(text)
        bwt = text[order - 1]
        self.n, self.top = len(text), int(text.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.top + 1))))
        self.wavelet = Wavelet(bwt, max(1, self.top.bit_length()))
        self.kept = order % SAMPLE == 0
        self.kept_rank = np.concatenate(([0], np.cumsum(self.kept)))
        self.places = order[self.kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of every pattern (a row of ``patterns``, padded at its end); all go backward together."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for i in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((i < lengths) & (lo < hi))
            if not len(live):
                continue
            c = patterns[live, i]
            known = (c >= 1) & (c <= self.top)
            s = np.where(known, c, 0)
            a = self.before[s] + self.wavelet.rank(s, lo[live])
            b = self.before[s] + self.wavelet.rank(s, hi[live])
            lo[live], hi[live] = a, np.where(known, b, a)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text places of index rows: LF steps to a row whose place is kept."""
        row, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = row[todo]
            done = self.kept[r]
            out[todo[done]] = self.places[self.kept_rank[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            s = self.wavelet.at(r)
            row[todo] = self.before[s] + self.wavelet.rank(s, r)
            steps[todo] += 1
        return out


class Windows:
    """The windows of a block of benchmark items: words as symbols, distinct windows, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        raw, at = kernels.flat_texts([t.encode() for _, t in items])
        _, _, h, first = kernels.words(raw, at, kernels.ALNUM)
        self.vocabulary, symbol = np.unique(h, return_inverse=True)
        symbol = np.append(symbol + 2, np.zeros(window, np.int64))  # 0 ends a text, 1 separates its runs
        n = np.diff(first)
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(len(items)), count)
        start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(n[item], window)
        rows = np.where(np.arange(window) < length[:, None], symbol[start[:, None] + np.arange(window)], 0)
        self.patterns, code = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(axis=1)
        order = np.lexsort((item, code.reshape(-1)))
        self.item_of = item[order]
        self.item_at = np.searchsorted(code.reshape(-1)[order], np.arange(len(self.patterns) + 1))
        self.names = [str(k) for k, _ in items]
        self.least = int(self.lengths.min()) if len(self.patterns) else 0
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def items(self, pattern: int) -> set[str]:
        """The items that hold a window."""
        return {self.names[i] for i in self.item_of[self.item_at[pattern] : self.item_at[pattern + 1]].tolist()}

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The words' symbols; 0 for words of no item."""
        out = np.zeros(len(h), np.int64)
        may = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, h[may])
        place[place == len(self.vocabulary)] = 0
        out[may] = np.where(self.vocabulary[place] == h[may], place + 2, 0)
        return out


def shard_hits(windows: Windows, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
    """Of one shard: which words are hit, and the items found in each row."""
    hit = np.zeros(len(h) + 1, np.int64)
    found: dict[int, set] = {}
    if not len(h) or not len(windows.patterns):
        return hit[:-1] > 0, found
    symbol = windows.symbols(h)
    edge = np.zeros(len(h) + 1, bool)
    edge[first] = True
    inside = symbol > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(stop) + 1
    long = ends - starts >= windows.least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return hit[:-1] > 0, found
    sizes = ends - starts + 1
    total = int(sizes.sum())
    run = np.repeat(np.arange(len(starts)), sizes)
    inner = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word = starts[run] + inner
    text = np.where(inner == sizes[run] - 1, 1, symbol[np.minimum(word, len(h) - 1)])
    index = FMIndex(text)
    lo, hi = index.search(windows.patterns, windows.lengths)
    which = np.flatnonzero(hi > lo)
    if not len(which):
        return hit[:-1] > 0, found
    counts = (hi - lo)[which]
    owner = np.repeat(which, counts)
    rows = np.repeat(lo[which], counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = word[index.locate(rows)]
    np.add.at(hit, place, 1)
    np.add.at(hit, place + windows.lengths[owner], -1)
    row = np.searchsorted(first, place, "right") - 1
    for key in np.unique(row * len(windows.patterns) + owner).tolist():
        r, w = divmod(key, len(windows.patterns))
        found.setdefault(r, set()).update(windows.items(w))
    return np.cumsum(hit[:-1]) > 0, found


def hit_runs(flag: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """The runs [word, word) of hit words, none across rows."""
    edge = np.zeros(len(flag) + 1, bool)
    edge[first] = True
    begin, close = flag.copy(), flag.copy()
    begin[1:] &= ~flag[:-1] | edge[1:-1]
    close[:-1] &= ~flag[1:] | edge[1:-1]
    return list(zip(np.flatnonzero(begin).tolist(), (np.flatnonzero(close) + 1).tolist(), strict=True))


def cut_texts(texts: pa.Array, spans: dict[int, list]) -> pa.Array:
    """The texts without their rows' spans."""
    out = texts.to_pylist()
    for r, own in spans.items():
        raw, at, keep = out[r].encode(), 0, []
        for s in own:
            keep.append(raw[at : s["start"]])
            at = s["stop"]
        out[r] = b"".join([*keep, raw[at:]]).decode()
    return pa.array(out, pa.string())


def item_blocks(items: DataFrame, item_id: str, text: str) -> tuple[str, list[str]]:
    """Writes the items to block files of BLOCK_BYTES of text at most (or one item each): their folder and names."""
    spark = items.sparkSession
    folder = new_folder(spark, "benchmark")
    src = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t")).where("t is not null")
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0

    def write(batches):
        part, block, size, names = TaskContext.get().partitionId(), [], 0, []

        def flush():
            names.append(f"{part:06d}-{len(names):06d}")
            put_file(folder, names[-1], [json.dumps(block).encode()])
            block.clear()

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(t.encode())
                if block and size + n > BLOCK_BYTES:
                    flush()
                    size = 0
                block.append((k, t))
                size += n
        if block:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    dealt = src.repartition(max(1, -(-size // BLOCK_BYTES)))
    return folder, sorted(r.name for r in arrow_map(dealt, write, "name string").collect())


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), cut: str | None = None) -> DataFrame:
    """Per row: key, n_words, n_hit words, items (sorted distinct ids of items with occurring windows), spans (merged removal
    spans as [byte start, byte end) pairs of the UTF-8 text) and the columns ``keep`` (which must not have these names), of
    which ``cut`` is the text and comes without its spans.  The texts are read once and not shuffled.
    """
    folder, names = item_blocks(items, item_id, item_text)
    src = docs.select(F.col(text).alias("__t"), F.col(key).alias("__k"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])
    types = dict(src.dtypes)
    schema = f"`{key}` {types['__k']}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>"
    schema += "".join(f", `{c}` {types[f'__{i}']}" for i, c in enumerate(keep))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def find(batches):
        held: dict[str, Windows] = {}

        def block(name):
            if name not in held:
                held.clear()
                held[name] = Windows(json.loads(get_file(folder, name)), window)
            return held[name]

        def rounds():
            """Batches that are judged together: with several blocks ROUND_BYTES of text, so that a block is made once for all of them."""
            own, size = [], 0
            for b in batches:
                own.append(b)
                size += b.column(0).nbytes
                if len(names) <= 1 or size >= ROUND_BYTES:
                    yield own
                    own, size = [], 0
            if own:
                yield own

        for together in rounds():
            shards = [(batch, *x) for batch in together for x in text_slices(batch.column(0), SHARD_BYTES)]
            seen = [[*kernels.words(raw, at, kernels.ALNUM)] for _, _, _, raw, at in shards]
            flags = [np.zeros(len(h), bool) for _, _, h, _ in seen]
            found: list[dict[int, set]] = [{} for _ in seen]
            for name in names:
                for (_, _, h, first), flag, all_found in zip(seen, flags, found, strict=True):
                    hit, own = shard_hits(block(name), h, first)
                    flag |= hit
                    for r, x in own.items():
                        all_found.setdefault(r, set()).update(x)
            for (batch, i, j, _, at), (start, end, _, first), flag, own in zip(shards, seen, flags, found, strict=True):
                sums = np.concatenate(([0], np.cumsum(flag)))
                got: dict[int, list] = {}
                for a, b in hit_runs(flag, first):
                    r = int(np.searchsorted(first, a, "right")) - 1
                    got.setdefault(r, []).append({"start": int(start[a] - at[r]), "stop": int(end[b - 1] - at[r])})
                part, rows = batch.slice(i, j - i), range(j - i)
                rest = list(part.columns[2:])
                if cut:
                    rest[keep.index(cut)] = cut_texts(rest[keep.index(cut)], got)
                columns = [
                    part.column(1),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array((sums[first[1:]] - sums[first[:-1]]).astype(np.int64)),
                    pa.array([sorted(own.get(r, ())) for r in rows], pa.list_(pa.string())),
                    pa.array([got.get(r, []) for r in rows], pa.list_(span)),
                ]
                yield pa.RecordBatch.from_arrays([*columns, *rest], [key, "n_words", "n_hit", "items", "spans", *keep])

    return arrow_map(src, find, schema)


def text_slices(column: pa.Array, size: int):
    """(rows from, to, bytes, offsets) of consecutive rows with about ``size`` bytes of text."""
    raw, at = kernels.flat(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def contamination_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items)
    ids = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        ids.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def sha_of_items(items: list[str]) -> str:
    """What items_sha256 is, in plain Python; for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with the removal spans cut from the texts and n_chars counted anew; clean texts stay as they are.  Columns of any name are kept."""
    columns = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    text = f"c{columns.index('text')}"
    key = f"c{columns.index('doc_id')}" if "doc_id" in columns else "c0"
    got = contamination(plain, items, key=key, text=text, keep=tuple(c for c in plain.columns if c != key), cut=text)
    of = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col(text).isNull(), of["n_chars"]).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return got.select(*[of[c].alias(c) for c in columns])


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM grams JOIN wins USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
