"""Whitening of embeddings by exact eigenvalues.

Entries become integers (x), so that the scatter matrix n * sum(x x') - S S' of the distinct vectors is exact.  Its characteristic
polynomial is found modulo primes by Hessenberg reduction, a task some primes, and put together by Chinese remainders.  All its roots are
real, so Descartes' rule counts the roots above a number exactly; the largest COMPONENTS are isolated by that count, narrowed by
the polynomial's sign, and give the components by inverse iteration with BITS binary digits.

At scale: distinct vectors are found by one shuffle (combined before it), their sums by parts, added by matrix cell; what the driver
gets depends on the dimension only.  Rows are projected where they are read.

Defined cases: rows with a null or empty vector, with null, infinite or not-a-number entries, or with entries of 2**56 or more have no row; of vectors of
several lengths those of the commonest count (of equally common: the longest), the others have no row; a component without
variance is 0 in all rows and left out of identity_error; a deviation that doesn't fit a long is null; repeated rows stay; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import arrow_map, cut

SCALE, BASE = 64, 1_000_000
#: Components at most; binary digits of inverse iteration, and those of eigenvalues behind the point.
COMPONENTS, BITS, POINT = 16, 320, 96
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x: the usable rows, x = floor(64 * entry) + 1000000."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**56))
    rows = embeddings.select("vec_id", v.alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    top = sizes.first()
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint") + BASE)
    return rows.where(F.size("v") == (top.d if top else 0)).select("vec_id", x.alias("x"))


def matrix(column, base: int = BASE) -> np.ndarray:
    """An Arrow list column of vectors of one length as a matrix, less base."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) - base


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers, exactly: products of doubles that stay under 2**53, of limbs of 20 bits where entries are large."""
    most, d = int(np.abs(y).max(initial=0)), y.shape[1]
    total = np.zeros((d, d), dtype=object)
    if most < 1 << 20:
        limbs = [y.astype(np.float64)]
    else:
        limbs = [((y >> 20 * i) & 0xFFFFF).astype(np.float64) for i in range(3)] + [(y >> 60).astype(np.float64)]
    chunk = 4096
    for at in range(0, len(y), chunk):
        for (i, a), (j, b) in itertools.product(enumerate(limbs), repeat=2):
            product = a[at : at + chunk].T @ b[at : at + chunk]
            total += product.astype(np.int64).astype(object) << (20 * (i + j))
    return total


def pieces(value: int):
    """value as signed digits to the base 10**15: sums of them over parts stay exact."""
    sign, value, i = (-1 if value < 0 else 1), abs(value), 0
    while value or not i:
        yield i, sign * (value % 10**15)
        value, i = value // 10**15, i + 1


@dataclass
class Fit:
    """n distinct vectors, their sums, and the components (rows) with their eigenvalues over the scatter matrix's."""

    n: int
    sums: list[int]
    values: list[float]
    explained: list[float]
    components: np.ndarray


def scatter(distinct: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums of x, n * sum(x x') - S S') of distinct x."""

    def part(batches):
        import pyarrow as pa

        n, sums, total = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            y = matrix(b.column("x"))
            n += len(y)
            s, g = [int(v) for v in y.astype(object).sum(axis=0)], gram(y)
            sums, total = (s, g) if sums is None else ([p + q for p, q in zip(sums, s, strict=True)], total + g)
        if n:
            d = len(sums)
            cells = [n, *sums, *(total[i, j] for i in range(d) for j in range(i, d))]
            rows = [(c, i, v) for c, x in enumerate(cells) for i, v in pieces(int(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cell", "piece", "v"])

    parts = arrow_map(distinct.select("x"), part, "cell int, piece int, v bigint")
    cells: dict[int, int] = {}
    for r in parts.groupBy("cell", "piece").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
        cells[r.cell] = cells.get(r.cell, 0) + int(r.v) * 10 ** (15 * r.piece)
    if not cells:
        return 0, [], []
    n, d = cells[0], (isqrt(8 * (len(cells) - 1) + 9) - 3) // 2
    s = [cells[1 + i] for i in range(d)]
    m = [[0] * d for _ in range(d)]
    for c, (i, j) in enumerate(((i, j) for i in range(d) for j in range(i, d)), d + 1):
        m[i][j] = m[j][i] = n * cells[c] - s[i] * s[j]
    return n, [v + n * BASE for v in s], m


# --- the characteristic polynomial ---


def is_prime(n: int) -> bool:
    """Miller-Rabin, certain for n below 3.4e9 with these bases."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def characteristic_modulo(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t I - m) modulo a prime p < 2**31, the lowest first."""
    h = np.array([[x % p for x in row] for row in m], dtype=np.int64)
    d = len(h)
    for k in range(d - 2):  # similar transformations to zero below the subdiagonal
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        # whole columns: the products are added below 2**63 by taking each modulo p first
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(axis=1)) % p
    polynomials = np.zeros((d + 1, d + 1), dtype=np.int64)
    polynomials[0, 0] = 1
    for k in range(d):
        q = np.zeros(d + 1, dtype=np.int64)
        q[1:] = polynomials[k, :-1]
        q = (q - h[k, k] * polynomials[k]) % p
        run, factors = 1, np.zeros(k, dtype=np.int64)
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            factors[i] = int(h[i, k]) * run % p
        q = (q - (factors[:, None] * polynomials[:k] % p).sum(axis=0)) % p
        polynomials[k + 1] = q
    return [int(x) for x in polynomials[d]]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(t I - m) of a symmetric positive semidefinite integer matrix, the lowest first."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # the k-th elementary symmetric function of roots >= 0 is at most comb(d, k) (trace / d) ** k
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes, product, p = [], 1, (1 << 31) - 1
    while product <= 4 * bound or len(primes) < 2:
        if is_prime(p):
            primes.append(p)
            product *= p
        p -= 2
    while not is_prime(p):
        p -= 2
    spare, texts = p, [[str(x) for x in row] for row in m]

    def part(batches):
        import pyarrow as pa

        own = [[int(x) for x in row] for row in texts]
        for b in batches:
            found = [characteristic_modulo(own, q) for q in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    frame = spark.createDataFrame([(q,) for q in [*primes, spare]], "p bigint").repartition(min(len(primes) + 1, spark.sparkContext.defaultParallelism), "p")
    rest = {r.p: r.c for r in arrow_map(frame, part, "p bigint, c array<bigint>").collect()}
    out, product = [0] * (d + 1), 1
    for q in primes:
        back = pow(product, -1, q)
        out = [x + product * ((r - x) * back % q) for x, r in zip(out, rest[q], strict=True)]
        product *= q
    out = [x - product if x > product // 2 else x for x in out]
    if any((x - r) % spare for x, r in zip(out, rest[spare], strict=True)):
        raise ArithmeticError("the characteristic polynomial disagrees with its remainder modulo a further prime")
    return out


# --- roots ---


class Roots:
    """The largest roots of a polynomial all of whose roots are real and none negative; numbers are scaled by 2**POINT."""

    def __init__(self, coefficients: list[int]):
        d = len(coefficients) - 1
        self.high = [c << POINT * (d - k) for k, c in reversed(list(enumerate(coefficients)))]
        self.counts: dict[int, int] = {}

    def above(self, a: int) -> int:
        """How many roots are above a, each as often as it is one: the changes of sign of p(t + a)."""
        if a not in self.counts:
            c, d = list(self.high), len(self.high) - 1
            for i in range(d):
                for j in range(1, d + 1 - i):
                    c[j] += a * c[j - 1]
            signs = [x > 0 for x in c if x]
            self.counts[a] = sum(x != y for x, y in itertools.pairwise(signs))
        return self.counts[a]

    def sign(self, a: int) -> int:
        v = 0
        for c in self.high:
            v = v * a + c
        return (v > 0) - (v < 0)

    def root(self, k: int, top: int) -> int:
        """The k-th largest root, rounded up to an integer of the scale; top is one that no root is above."""
        low, high = -1, top
        for a, n in sorted(self.counts.items()):
            if n >= k:
                low = max(low, a)
            else:
                high = min(high, a)
        while high - low > 1 and not self.above(low) - self.above(high) == 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.above(mid) >= k else (low, mid)
        at_high = self.sign(high) if high - low > 1 else 1
        if at_high == 0:
            return high
        while high - low > 1:  # one root in between: the sign tells on which side
            mid = (low + high) // 2
            s = self.sign(mid)
            if s == 0:
                return mid
            low, high = (low, mid) if s == at_high else (mid, high)
        return high


def null_vectors(m: list[list[int]], root: int, count: int) -> list[list[int]]:
    """Orthonormal vectors (scaled by 2**BITS) of m's eigenspace of a root (scaled by 2**POINT): inverse iteration with one elimination."""
    d, one = len(m), 1 << BITS
    a = np.array([[(x << BITS) - ((root << (BITS - POINT)) if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(m)], dtype=object)
    factors = []
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        f = np.array([(x << BITS) // a[k, k] for x in a[k + 1 :, k]], dtype=object)
        for i, x in enumerate(f):
            if x:
                a[k + 1 + i, k:] -= (x * a[k, k:]) >> BITS
        factors.append((at, f))

    def solve(b: list[int]) -> list[int]:
        b = list(b)
        for k, (at, f) in enumerate(factors):
            b[k], b[at] = b[at], b[k]
            for i, x in enumerate(f):
                b[k + 1 + i] -= (x * b[k]) >> BITS
        for k in range(d - 1, -1, -1):
            b[k] = ((b[k] - (sum(int(a[k, j]) * b[j] for j in range(k + 1, d)) >> BITS)) << BITS) // int(a[k, k])
        return b

    def unit(v: list[int]) -> list[int]:
        top = max(map(abs, v)) or 1
        v = [(x << BITS) // top for x in v]
        norm = isqrt(sum(x * x for x in v)) or 1
        return [(x << BITS) // norm for x in v]

    found: list[list[int]] = []
    seed = np.random.default_rng(d)
    for _ in range(count):
        v = unit([int(x) * one // 1000 for x in seed.integers(1, 1000, d)])
        for _ in range(3):
            v = unit(solve(v))
            for _ in range(2):
                for u in found:
                    dot = sum(x * y for x, y in zip(u, v, strict=True)) >> BITS
                    v = [x - ((dot * y) >> BITS) for x, y in zip(v, u, strict=True)]
                v = unit(v)
        found.append(v if max(v, key=abs) > 0 else [-x for x in v])
    return found


def fit(distinct: DataFrame) -> Fit | None:
    """The components of distinct vectors; None of none."""
    n, sums, m = scatter(distinct)
    if not n:
        return None
    d, trace = len(sums), sum(m[i][i] for i in range(len(sums)))
    k = min(COMPONENTS, d)
    if not trace:
        return Fit(n, sums, [0.0] * k, [0.0] * k, np.eye(d)[:k])
    roots = Roots(characteristic(distinct.sparkSession, m))
    found = [roots.root(i + 1, (trace << POINT) + 1) for i in range(k)]
    vectors_of, out = {}, []
    for i, r in enumerate(found):
        # roots that agree in 80 binary digits are one
        same = next((q for q in vectors_of if abs(q - r) <= max(1, r >> 80)), None)
        if same is None:
            group = [j for j in range(i, k) if abs(found[j] - r) <= max(1, r >> 80)]
            vectors_of[r] = iter(null_vectors(m, r, len(group)))
            same = r
        out.append([x / (1 << BITS) for x in next(vectors_of[same])])
    values = [r / (1 << POINT) for r in found]
    # a root of 0 is rounded up to one unit of the scale
    values = [0.0 if r <= 1 else v for r, v in zip(found, values, strict=True)]
    return Fit(n, sums, values, [v / trace for v in values], np.array(out))


def projected(x, model: Fit) -> tuple[list[int | None], np.ndarray]:
    """(sums of squares of n * x - S, whitened values) of an Arrow column of vectors."""
    y = matrix(x)
    shift = [s - model.n * BASE for s in model.sums]
    most = model.n * int(np.abs(y).max(initial=0)) + max(map(abs, shift))
    if most * most * len(shift) < 1 << 62:
        t = y * model.n - np.array(shift, dtype=np.int64)
        deviation = (t * t).sum(axis=1).tolist()
    else:
        t = y.astype(object) * model.n - np.array(shift, dtype=object)
        deviation = [v if v < 1 << 63 else None for v in map(int, (t * t).sum(axis=1))]
    scale = np.array([v**-0.5 if v else 0.0 for v in model.values])
    return deviation, (t.astype(np.float64) @ model.components.T) * scale


def identity_error(distinct: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened distinct vectors' covariance less the identity."""
    live = [i for i, v in enumerate(model.values) if v]

    def part(batches):
        import pyarrow as pa

        k = len(live)
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = projected(b.column("x"), model)[1][:, live]
                first += w.sum(axis=0)
                second += w.T @ w
        cells = [*first, *second.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.float64())], names=["cell", "v"])

    if not live:
        return 0.0
    k, cells = len(live), {}
    for r in arrow_map(distinct.select("x"), part, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        cells[r.cell] = r.v
    mean = np.array([cells[i] for i in range(k)]) / model.n
    second = np.array([cells[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame) -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    distinct = cut(rows.select("x").distinct())
    model = fit(distinct)
    if model is None:
        return spark.createDataFrame([], OUT)
    error = identity_error(distinct, model)

    def part(batches):
        import pyarrow as pa

        k = len(model.values)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.slice(at, 4096)
                deviation, w = projected(own.column("x"), model)
                each = np.repeat(np.arange(own.num_rows), k)
                columns = [
                    own.column("vec_id").cast(pa.int64()).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), own.num_rows)),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model.explained, own.num_rows)),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return arrow_map(rows, part, OUT)
