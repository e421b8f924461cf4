"""A quality score from preference pairs.

Each pair is a labelled good and a labelled bad document.  By the Bradley-Terry model the good one is preferred with
probability sigmoid(w . (x_good - x_bad)); w is learned by logistic loss on feature differences.  A document's strength is
w . x, and the threshold is the quantile of the learned documents' strengths at the bad documents' share.  The score is
sigmoid((strength - threshold) / scale), so that 0.5 is the threshold.

The fit takes every labelled row and every pair of a good and a bad one; the features of every document are counts over its
whole text.  What a step needs of the pairs are sums of the rows by class and strength in cells of 1/CELL, as the logistic loss of a
pair depends on the two strengths only: tasks add them up over their rows, so the work grows with the rows, not the pairs.
Features are whole numbers of 1/GRID (those above 32,767 count as that), so the sums are exact and don't depend on how the rows
are dealt.

Defined cases: null and empty texts have all-zero counts and are scored like any other; without labelled rows of both
classes every score is 0.5; of repeated rows of a document or its label one counts in the fit; labels that are null or of no document are left out; an
empty table gives an empty result; further columns are ignored or, by keep_good, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .langid import held_out
from .session import arrow_map, cut

#: Steps of the fit at most, and the step's size (in strengths) from which it is done.
STEPS, DONE = 60, 1e-4
#: Parts of one in which features, expanded features and weights are counted.
GRID, UNIT, WEIGHT = 1 << 16, 1 << 12, 1 << 20
#: Cells of a strength: of the pairs, and of the threshold.
CELL, FINE = 16, 1 << 14
RIDGE = 1e-4
#: Bins of a feature.
BINS = 8
STEP_BYTES, STEP_ROWS = 4 << 20, 2000
NAMES = ("log words", "log bytes a word", "distinct words", "repeated next word", "repeated word after next", "distinct pairs", "upper case", "digits", "commas", "stops", "marks", "bars", "other signs", "beyond ASCII", "lines a word", "distinct lines", "longest word", "end marks", "capital words", "one-byte words", "most frequent word")


def _classes() -> np.ndarray:
    c = np.zeros((9, 256), np.int64)
    c[0, 65:91] = 1
    c[1, 48:58] = 1
    c[2, 44] = 1
    c[3, 46] = 1
    c[4, [33, 63]] = 1
    c[5, 124] = 1
    c[6, [*range(34, 44), 45, 47, *range(58, 63), 64, *range(91, 97), 123, 125, 126]] = 1
    c[7, 128:] = 1
    c[8, 10] = 1
    return c


CLASSES = _classes()


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of figures for each text."""
    n = len(at) - 1
    start, end, h, first = kernels.words(raw, at, kernels.SPACE)
    words, size = np.diff(first), np.diff(at)
    row = np.repeat(np.arange(n), words)

    def sums(values, where=first):
        c = np.concatenate(([0], np.cumsum(values)))
        return c[where[1:]] - c[where[:-1]]

    def share(a, b):
        return a / np.maximum(b, 1)

    def distinct(hashes, rows, fewest):
        order = np.lexsort((hashes, rows))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        times = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        own = rows[order][fresh]
        most = np.zeros(n, np.int64)
        np.maximum.at(most, own, times)
        return np.bincount(own, minlength=n)[:fewest], most

    same = lambda k: np.concatenate(((h[k:] == h[:-k]) & (row[k:] == row[:-k]), np.zeros(min(k, len(h)), bool)))[: len(h)] if len(h) else np.zeros(0, bool)
    pair = kernels.mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(7)) if len(h) > 1 else np.empty(0, np.uint64)
    in_row = row[1:] == row[:-1]
    kinds, most = distinct(h, row, n)
    pairs, _ = distinct(pair[in_row], row[:-1][in_row], n)
    counts = []
    for k in range(9):
        counts.append(np.add.reduceat(np.append(CLASSES[k].astype(np.int32)[raw], 0), at[:-1]) * (size > 0) if n else np.zeros(0))
    upper, digits, commas, stops, marks, bars, others, beyond, lines = counts
    ends = np.zeros(len(raw) + 1, np.uint8)
    ends[:-1] = raw
    long = np.zeros(n, np.int64)
    np.maximum.at(long, row, end - start)
    last = ends[np.maximum(end - 1, 0)] if len(end) else ends[:0]
    lead = ends[start] if len(start) else ends[:0]
    # lines: hash of a line is that of its words
    broke = np.concatenate(([0], np.cumsum(raw == 10)))
    line = broke[start] if len(start) else np.empty(0, np.int64)
    line_cut = np.ones(len(h), bool)
    line_cut[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(line_cut)
    line_hash = np.add.reduceat(
        kernels.mix(h + (np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))).astype(np.uint64)),
        heads,
    ) if len(heads) else np.empty(0, np.uint64)
    line_row = row[heads]
    line_kinds, _ = distinct(line_hash, line_row, n)
    line_count = np.bincount(line_row, minlength=n)[:n]
    f = [
        np.log1p(words), np.log1p(share(size, words)), share(kinds, np.sqrt(np.maximum(words, 1) * 10.0)), share(sums(same(1)), words), share(sums(same(2)), words), share(pairs, np.maximum(words - 1, 1)),
        share(upper, size), share(digits, size), share(commas, words), share(stops, words), share(marks, words), share(bars, words), share(others, size), share(beyond, size), share(lines, words), share(line_kinds, line_count),
        np.log1p(long), share(sums((last == 33) | (last == 63)), words), share(sums((lead >= 65) & (lead <= 90)), words), share(sums(end - start == 1), words), share(most, words),
    ]
    return np.stack([np.asarray(x, np.float64) for x in f], 1) if n else np.empty((0, len(NAMES)))


def on_grid(x: np.ndarray) -> np.ndarray:
    """Features in whole parts of 1/GRID."""
    return np.rint(np.clip(x * GRID, -(1 << 31), (1 << 31) - 1)).astype(np.int32)


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


class Rows:
    """Rows of features on the grid and their labels, in memory."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def bins(self) -> list[tuple]:
        """Of each feature: mean, spread, cuts of BINS equal parts."""
        x = self.x.astype(np.float64)
        cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        return [(m, d, c.tolist()) for m, d, c in zip(x.mean(0), x.std(0), cuts.T, strict=True)]

    def sums(self, of) -> tuple[np.ndarray, np.ndarray]:
        """The keys and rows of whole numbers that ``of`` makes of features and labels, added up by key."""
        return added(*of(self.x, self.y))


class Table:
    """The same of a table (y, x), added up in tasks; the driver gets one row a key from each of as many tasks as there are cores."""

    def __init__(self, df: DataFrame):
        self.df = df

    def bins(self) -> list[tuple]:
        values = self.df.select(F.posexplode("x").alias("j", "v")).groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
        v, n = F.col("v").cast("decimal(12,0)"), F.col("n").cast("decimal(12,0)")
        cuts = [float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]]
        got = values.groupBy("j").agg(F.percentile("v", cuts, F.col("n")).alias("cuts"), F.sum("n").alias("n"), F.sum(v * n).alias("s"), F.sum((v * v).cast("decimal(20,0)") * n).alias("q")).collect()
        out = []
        for r in sorted(got, key=lambda r: r.j):
            total, square = int(r.s), int(r.q)
            out.append((total / r.n, ((r.n * square - total * total) / (r.n * r.n)) ** 0.5, r.cuts))
        return out

    def sums(self, of) -> tuple[np.ndarray, np.ndarray]:
        def work(batches):
            got = None
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
                    new = added(*of(x, np.asarray(batch.column(0))))
                    got = new if got is None else added(*[np.concatenate(c) for c in zip(got, new, strict=True)])
            if got is not None and len(got[0]):
                keys, values = got
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * values.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))], ["k", "v"])

        few = self.df.coalesce(max(1, self.df.sparkSession.sparkContext.defaultParallelism))
        got = arrow_map(few, work, "k bigint, v array<bigint>").toArrow()
        keys = got["k"].to_numpy()
        return added(keys, got["v"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1))


class Model:
    """Weights over binned features; strength is their sum."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, bad_share: float):
        self.learn(Rows(on_grid(np.concatenate((good, bad))), np.repeat([1, 0], [len(good), len(bad)])), bad_share)

    @classmethod
    def of(cls, data: Table, bad_share: float) -> Model:
        model = cls.__new__(cls)
        model.learn(data, bad_share)
        return model

    def learn(self, data: Rows | Table, bad_share: float) -> None:
        bins = data.bins()
        self.mean, self.spread = np.array([b[0] for b in bins]) / GRID, np.array([b[1] for b in bins]) / GRID + 1e-9
        self.edges = [np.unique(b[2]) / GRID for b in bins]
        self.w = np.zeros(len(bins) + sum(map(len, self.edges)))
        # no curvature of the loss is above a quarter of the pairs' mean squares, so steps by these never go too far
        unit = np.append(1, np.full(len(self.w), UNIT))
        bad, good = data.sums(self.squares)[1].reshape(2, len(unit), len(unit)) / np.outer(unit, unit)
        bad, good = bad / bad[0, 0], good / good[0, 0]
        apart = good[0, 1:] - bad[0, 1:]
        cover = np.outer(apart, apart) + sum(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) for m in (good, bad))
        bound = cover / 4 + RIDGE * np.eye(len(self.w))
        best, at, t = self.w, self.w, 1
        for _ in range(STEPS):
            self.w = np.rint(at * WEIGHT) / WEIGHT
            slope = self.slope(*data.sums(self.cells))
            new = self.w - np.linalg.solve(bound, slope)
            step = new - best
            if slope @ step > 0:  # past the least one: the momentum starts anew
                t = 1
            best, at = new, new + (t - 1) / (t + 2) * step
            t += 1
            if (step @ cover @ step) ** 0.5 < DONE:
                break
        self.w = np.rint(best * WEIGHT) / WEIGHT
        self.place(data, bad_share)

    def slope(self, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The loss's gradient at w, of all pairs, from the sums of cells."""
        n, x = sums[:, 0].astype(np.float64), sums[:, 1:] / UNIT
        strength, good = x @ self.w / n, keys % 2 == 1
        lost = 1 / (1 + np.exp(np.clip(strength[good][:, None] - strength[~good][None, :], -40, 40)))
        per_good, per_bad = lost @ n[~good], n[good] @ lost  # of each row of a cell, over all of the other class
        return (per_bad @ x[~good] - per_good @ x[good]) / (n[good].sum() * n[~good].sum()) + RIDGE * self.w

    def place(self, data: Rows | Table, bad_share: float) -> None:
        """Threshold and scale: the quantile of all strengths at the bad documents' share, and the medians' distance."""
        keys, n = data.sums(self.counts)
        n, good = n[:, 0], keys % 2 == 1
        every = np.ones(len(keys), bool)
        total = int(n.sum())
        below = min(max(1, int(bad_share * total + 1e-6)), total - 1)
        middle = lambda m: [(int(n[m].sum()) - 1) // 2, int(n[m].sum()) // 2]
        wanted = [(None, below - 1), (None, below), *[(c, r) for c in (1, 0) for r in middle(good == c)]]
        found = []
        for c, rank in wanted:
            use = every if c is None else good == c
            found.append(keys[use][np.searchsorted(np.cumsum(n[use]), rank, "right")] // 2)
        fine, m = data.sums(lambda x, y: self.counts(x, y, FINE, np.unique(found)))
        m = m[:, 0]
        at = []
        for (c, rank), cell in zip(wanted, found, strict=True):
            use = every if c is None else good == c
            own = (fine // 2 // (FINE // CELL) == cell) & (True if c is None else fine % 2 == c)
            left = rank - int(n[use & (keys // 2 < cell)].sum())
            at.append((fine[own][np.searchsorted(np.cumsum(m[own]), left, "right")] // 2 + 0.5) / FINE)
        low, high, *medians = at
        self.threshold = (low + high) / 2
        self.scale = max(1e-6, (sum(medians[:2]) - sum(medians[2:])) / 2 / 8)

    def expand(self, x: np.ndarray) -> np.ndarray:
        x = on_grid(x) / GRID
        out = [np.rint(np.clip((x - self.mean) / self.spread, -4, 4) * UNIT) / UNIT]
        for j, e in enumerate(self.edges):
            if len(e):
                out.append((x[:, j : j + 1] > e[None, :]).astype(np.float64))
        return np.concatenate(out, 1)

    def units(self, x: np.ndarray) -> np.ndarray:
        """One and the expanded features of rows on the grid, as whole numbers."""
        return np.concatenate((np.ones((len(x), 1)), self.expand(x / GRID) * UNIT), 1)

    def squares(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self.units(x)
        return np.arange(2), np.stack([(u[y == c].T @ u[y == c]).astype(np.int64).reshape(-1) for c in (0, 1)])

    def cells(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self.units(x)
        keys, sums = added(np.floor(u[:, 1:] @ self.w * (CELL / UNIT)).astype(np.int64) * 2 + y, u)
        return keys, sums.astype(np.int64)

    def counts(self, x: np.ndarray, y: np.ndarray, parts: int = CELL, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows by strength in cells of 1/parts; only of the cells of 1/CELL ``within``, where given."""
        strength = self.units(x)[:, 1:] @ self.w / UNIT
        keys = np.floor(strength * parts).astype(np.int64) * 2 + y
        if within is not None:
            keys = keys[np.isin(np.floor(strength * CELL), within)]
        return keys, np.ones((len(keys), 1), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.expand(x) @ self.w - self.threshold) / self.scale, -500, 500)))


def scored_parts(batch: pa.RecordBatch, column: int):
    """Features of a batch, in steps of bounded size."""
    raw, at = kernels.flat(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP_BYTES, "right")) - 1)
        yield features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def counted(docs: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` as c0, c1 and so on, and the features on the grid, x; one pass, no shuffle."""
    src = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("__t"))
    names = src.columns[:-1]
    schema = ", ".join(f"{c} {t}" for c, t in src.dtypes[:-1])

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                x = on_grid(np.concatenate(list(scored_parts(batch, len(names)))))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], [*names, "x"])

    return arrow_map(src, work, f"{schema}, x array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """Learns from all labels (doc_id, label 0 or 1) that have a document, each doc_id once: of several labels the smallest, of several rows the one of the smallest features."""
    return fit_counted(counted(docs), labels, label)


def fit_counted(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """The same of rows of c0, the doc_id, and x."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("__k"), F.col(label).cast("bigint").alias("__y"))
        .groupBy("__k")
        .agg(F.min("__y").alias("__y"))
    )
    learned = rows.select(F.col("c0").alias("__k"), "x").join(known, "__k").groupBy("__k").agg(F.min("__y").alias("y"), F.min("x").alias("x"))
    learned = cut(learned.select("y", "x"))
    counts = dict(learned.groupBy("y").count().collect())
    if not counts.get(0) or not counts.get(1):
        return None
    return Model.of(Table(learned), counts[0] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` as c0, c1 and so on, score, predicted; one pass, no shuffle."""
    text = keep.index("text") if "text" in [c for c in keep if isinstance(c, str)] else None
    src = docs.select(
        *[F.col(c).alias(f"c{i}") if isinstance(c, str) else c.alias(f"c{i}") for i, c in enumerate(keep)],
        *([F.col("text").alias("__t")] if text is None else []),
    )
    where = len(keep) if text is None else text
    names = [f"c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{c} {t}" for c, t in src.dtypes[: len(keep)])

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                x = np.concatenate(list(scored_parts(batch, where)))
                s = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    [*names, "score", "predicted"],
                )

    return arrow_map(src, work, f"{schema}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels that are not held out (crc32 of doc_id modulo 3 is not 1).  Texts are read once: what is learned and scored are their features."""
    out = held_out("doc_id", 3, 1)
    rows = cut(counted(docs, ("doc_id", out)))
    model = fit_counted(rows, labels.where(~out))

    def work(batches):
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, len(NAMES))
            s = model.score(x / GRID) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    types = dict(rows.dtypes)
    return arrow_map(rows, work, f"doc_id {types['c0']}, held_out {types['c1']}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects."""
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    rest = docs.columns
    got = score(docs, model, tuple(rest)).where("predicted = 1")
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)])
