"""Joins on ranges and as of a time, sketches, measured joins and grains."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import sketches
from loomtrace.measures import QUERIES
from loomtrace.operators import measured, ranged


def test_range_join(spark):
    rng = random.Random(1)
    points = [(i, rng.choice([5.0, rng.uniform(-50, 50), float(rng.randrange(-9, 9))])) for i in range(600)] + [(-1, None), (-2, float("nan")), (7, 5.0)]
    intervals = []
    for j in range(150):
        a = rng.choice([5.0, rng.uniform(-60, 60), float(rng.randrange(-9, 9))])
        intervals.append((j, a, a + rng.choice([0.0, 0.001, 1.0, 3.7, 64.0, -1.0])))
    intervals += [(900, None, 4.0), (901, float("nan"), 4.0), (902, -1e9, 1e9), (3, *intervals[3][1:])]
    p, i = spark.createDataFrame(points, "p bigint, x double"), spark.createDataFrame(intervals, "j bigint, a double, z double")
    got = ranged.range_join(p, i, "x", "a", "z")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((k, j) for k, x in points for j, a, z in intervals if x is not None and x == x and a is not None and a == a and a <= x <= z)
    assert sorted((r.p, r.j) for r in got.select("p", "j").collect()) == want
    assert ranged.range_join(p, i.where("false"), "x", "a", "z").count() == 0 == ranged.range_join(p.where("false"), i, "x", "a", "z").count()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_as_of_join(spark, strict, keys):
    rng = random.Random(2)
    left = [(i, rng.choice([1, 1, 1, 1, 2, None]), rng.choice([rng.randrange(40), rng.randrange(40), None])) for i in range(400)]
    right = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.randrange(40), None]), rng.choice([rng.randrange(1000), None])) for _ in range(200)]
    got = ranged.as_of_join(spark.createDataFrame(left, "i bigint, k int, t int"), spark.createDataFrame(right, "k int, t int, v bigint"), keys, "t", "v", strict=strict)

    def found(k, t):
        if t is None or keys and k is None:
            return None
        able = [(rt, v) for rk, rt, v in right if rt is not None and v is not None and (not keys or rk == k) and (rt < t or rt == t and not strict)]
        return max(able)[1] if able else None

    assert {r.i: r.found for r in got.collect()} == {i: found(k, t) for i, k, t in left} and got.count() == 400


def test_sketches(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 4000).alias("x")).repartition(4)
    path = str(tmp_path / "s")
    for half in (df.where("g < 2"), df.where("g >= 1")):  # rows of g = 1 come twice, and count once
        kept = sketches.stored(spark, sketches.sketches(half, ["g"], "x"), path)
    got = {r.g: r.estimate for r in sketches.estimates(kept, ["g"]).collect()}
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("x").alias("n")).collect()}
    assert got.keys() == exact.keys() and all(abs(got[g] - exact[g]) <= 0.05 * exact[g] for g in got) and kept.count() >= 4


def test_measured_joins(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region", "customer")}
    got = measured.measured_joins(spark, [("a", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey"), ("b", "SELECT a.n_name FROM nation a JOIN customer c ON a.n_regionkey = c.c_nationkey"), ("c", "SELECT n_name FROM nation JOIN nope ON n_regionkey = x")], tables).collect()
    assert {(r.query_id, r.risk, r.level) for r in got} == {("a", "medium", "warning"), ("b", "high", "error")}
    assert next(r.joined_rows for r in got if r.query_id == "a") == 25


def test_range_counts(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([5.0, -0.0, 0.0, float("inf"), rng.uniform(-50, 50), float(rng.randrange(-9, 9))])) for i in range(900)] + [(-1, None), (-2, float("nan"))]
    intervals = []
    for j in range(200):
        a = rng.choice([5.0, 0.0, -0.0, rng.uniform(-60, 60), float(rng.randrange(-9, 9))])
        intervals.append((j, a, a + rng.choice([0.0, 0.001, 1.0, 3.7, 64.0, -1.0])))
    intervals += [(900, None, 4.0), (901, float("nan"), 4.0), (902, 4.0, float("nan")), (903, -1e9, float("inf")), (904, 4.0, None), (3, *intervals[3][1:]), (None, 0.0, 9.0)]
    p, i = spark.createDataFrame(points, "p bigint, x double"), spark.createDataFrame(intervals, "j bigint, a double, z double")
    none = lambda v: v is None or v != v
    want = sorted(((j, 0 if none(a) or none(z) else sum(not none(x) and a <= x <= z for _, x in points)) for j, a, z in intervals), key=str)
    got = ranged.range_counts(p, i, "x", "a", "z")
    assert got.columns == ["j", "a", "z", "n"] and sorted(((r.j, r.n) for r in got.collect()), key=str) == want
    assert ranged.range_counts(p, i.where("false"), "x", "a", "z").count() == 0 and {r.n for r in ranged.range_counts(p.where("false"), i, "x", "a", "z").collect()} == {0}


def test_bands_make_no_pairs(spark, tmp_path):
    # 90,000 orders in each of 100,000 bands: nine billion pairs
    spark.range(90_000).selectExpr("id AS o_orderkey", "CAST(100000 + id % 7 AS DOUBLE) AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(100_000).selectExpr("id AS p_partkey", "CAST(1000 AS DOUBLE) AS p_retailprice", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["join_range_bands"](spark, str(tmp_path))
    assert [tuple(r) for r in got.groupBy("n").count().collect()] == [(90_000, 100_000)]
