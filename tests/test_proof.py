"""Lineage of writes, nested scopes, lambdas, made relations, recursion and reshaping."""

import pytest

from loomtrace import proven
from loomtrace.operators import proof
from loomtrace.operators.analysis import Analysis
from loomtrace.queries import driver_catalog
from loomtrace.sources import catalog

TABLES = {"nation": "n_nationkey int, n_name string, n_regionkey int", "region": "r_regionkey int, r_name string"}
N, R, OUT = "column:default.nation.", "column:default.region.", "output_column:scope:root:"
STATEMENTS = {
    "insert": "INSERT INTO nation SELECT r_regionkey, r_name, r_regionkey + 1 FROM region",
    "listed": "INSERT INTO nation (n_name, n_nationkey) SELECT r_name, 7 FROM region",
    "by_name": "INSERT INTO nation BY NAME SELECT r_name AS n_name, r_regionkey AS nope FROM region",
    "short": "INSERT INTO nation SELECT r_regionkey FROM region",
    "lost": "INSERT INTO nowhere SELECT r_name FROM region",
    "created": "CREATE OR REPLACE TEMP VIEW v (a, b) AS SELECT * FROM region",
    "several": "FROM region INSERT INTO nation SELECT r_regionkey, r_name, 0 WHERE r_regionkey > 1 INSERT INTO nation (n_name) SELECT r_name",
    "merge": "MERGE INTO nation t USING (SELECT r_regionkey AS k, r_name AS v FROM region) s ON t.n_nationkey = s.k WHEN MATCHED AND s.k > 3 THEN UPDATE SET n_name = concat(s.v, t.n_name) WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name) VALUES (s.k, s.v)",
    "merge_star": "MERGE INTO region t USING region s ON t.r_regionkey = s.r_regionkey WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *",
    "update": "UPDATE nation SET n_name = upper(n_name) WHERE n_regionkey = 2",
    "delete": "DELETE FROM nation WHERE n_regionkey = 2",
    "drop": "DROP TABLE nation",
    "scalar": "SELECT n_name, (SELECT max(r_name) FROM region WHERE r_regionkey = n.n_regionkey) AS r FROM nation n",
    "nearest": "SELECT (SELECT min(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS m, (SELECT max(r_name) FROM region x WHERE x.r_regionkey < region.r_regionkey) AS p FROM region",
    "lateral": "SELECT x.m FROM region r, LATERAL (SELECT max(n_name) AS m FROM nation WHERE n_regionkey = r.r_regionkey) x",
    "lateral_blind": "SELECT x.m FROM LATERAL (SELECT r.r_name AS m) x, region r",
    "aliases": "WITH c(x, y) AS (SELECT * FROM region) SELECT d.q FROM c AS d(p, q)",
    "lambda": "SELECT transform(split(n_name, ' '), e -> concat(e, r_name)) AS q, filter(array(1), n_name -> n_name > 0) AS s FROM nation JOIN region ON n_regionkey = r_regionkey",
    "values": "SELECT v.b FROM VALUES (1, 2) AS v(a, b)",
    "recursive": "WITH RECURSIVE t(k, n) AS (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, t.n FROM t JOIN region ON t.k = r_regionkey + 1) SELECT k, n FROM t",
    "pivot": "SELECT * FROM nation PIVOT (MAX(n_name) FOR n_regionkey IN (0 AS zero, 1))",
    "unpivot": "SELECT * FROM region UNPIVOT (v FOR k IN (r_name AS a))",
    "unknown_inside": "SELECT (SELECT max(x) FROM hidden) AS m FROM region",
}


@pytest.fixture(scope="module")
def explained(spark):
    a = Analysis(spark, list(STATEMENTS.items()), catalog.columns_from(spark, TABLES))
    edges = {}
    for r in a.edges.collect():
        edges.setdefault(r.query_id, set()).add((r.edge_type, r.source, r.target))
    return edges, {r.query_id: r.status for r in a.statuses.collect()}, {(r.query_id, r.code, r.related) for r in a.diagnostics.collect()}


def writes(edges, name):
    return {(s, t) for k, s, t in edges.get(name, ()) if k == "write"}


def test_writes(explained):
    edges, status, diagnostics = explained
    assert writes(edges, "insert") == {(R + "r_regionkey", N + "n_nationkey"), (R + "r_name", N + "n_name"), (R + "r_regionkey", N + "n_regionkey")}
    assert writes(edges, "listed") == {(R + "r_name", N + "n_name"), ("literal:write:0:2", N + "n_nationkey")}
    assert writes(edges, "by_name") == {(R + "r_name", N + "n_name")} and ("by_name", "UNKNOWN_COLUMN", "nation.nope") in diagnostics
    assert ("short", "WRITE_COLUMNS_DIFFER", "nation: 1 values, 3 columns") in diagnostics and status["short"] == "partial"
    assert ("lost", "UNKNOWN_TABLE", "nowhere") in diagnostics
    assert writes(edges, "created") == {(R + "r_regionkey", "column:default.v.a"), (R + "r_name", "column:default.v.b")}
    assert writes(edges, "several") == {(R + "r_regionkey", N + "n_nationkey"), (R + "r_name", N + "n_name"), ("literal:write:0:3", N + "n_regionkey")}
    assert writes(edges, "merge") == {(R + "r_name", N + "n_name"), (N + "n_name", N + "n_name"), (R + "r_regionkey", N + "n_nationkey")}
    assert writes(edges, "merge_star") == {(R + c, R + c) for c in ("r_regionkey", "r_name")}
    assert writes(edges, "update") == {(N + "n_name", N + "n_name")} and writes(edges, "delete") == set()
    assert all(status[q] == "success" for q in ("insert", "merge", "update", "delete", "created"))
    assert status["drop"] == "partial" and ("drop", "NOT_SUPPORTED_IN_P0", "DROP TABLE") in diagnostics


def test_nested_scopes(explained):
    edges, status, diagnostics = explained
    assert edges["scalar"] == {("projection", N + "n_name", OUT + "1:n_name"), ("subquery", R + "r_name", OUT + "2:r"), ("correlation", N + "n_regionkey", OUT + "2:r"), ("correlation", R + "r_regionkey", N + "n_regionkey")}
    assert {e for e in edges["nearest"] if e[0] == "subquery"} == {("subquery", N + "n_name", OUT + "1:m"), ("subquery", R + "r_name", OUT + "2:p")}
    assert ("alias", N + "n_name", OUT + "1:m") in edges["lateral"] and ("correlation", N + "n_regionkey", R + "r_regionkey") in edges["lateral"]
    assert ("lateral_blind", "UNKNOWN_COLUMN", "r.r_name") in diagnostics
    assert ("unknown_inside", "UNKNOWN_TABLE", "hidden") in diagnostics and status["unknown_inside"] == "partial"


def test_names_made_in_place(explained):
    edges, status, _ = explained
    assert ("alias", R + "r_name", OUT + "1:q") in edges["aliases"]
    assert {s for _, s, t in edges["lambda"] if t == OUT + "1:q"} == {N + "n_name", R + "r_name"} and not any(t == OUT + "2:s" and s == N + "n_name" for _, s, t in edges["lambda"])
    assert edges["values"] == {("projection", "generated:__derived_1.b", OUT + "1:b")} and status["values"] == "success"
    assert {s for _, s, t in edges["recursive"] if t == OUT + "1:k"} == {N + "n_nationkey", R + "r_regionkey"} and {s for _, s, t in edges["recursive"] if t == OUT + "2:n"} == {N + "n_name"}
    assert {s for _, s, t in edges["pivot"] if t.endswith("zero")} == {N + "n_name", N + "n_regionkey"} and ("projection", N + "n_nationkey", OUT + "1:n_nationkey") in edges["pivot"]
    assert {t.split(":")[-1]: s for _, s, t in edges["unpivot"]} == {"r_regionkey": R + "r_regionkey", "k": "generated:__derived_1.k", "v": R + "r_name"}


def test_given_catalog(spark, sf_dir):
    assert driver_catalog(spark, sf_dir, ("nation",)).count() == 3


def _plans(monkeypatch):
    plans, digest = [], proof.digest
    monkeypatch.setattr(proof, "digest", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), digest(df))[1])
    return plans


def test_counting_rows_reads_no_column(spark, sf_dir, monkeypatch):
    plans = _plans(monkeypatch)
    tables = {"nation": spark.read.parquet(f"{sf_dir}/nation.parquet")}
    got = proof.influences(spark, [("q", "SELECT n_regionkey, COUNT( * ) AS n FROM nation GROUP BY n_regionkey")], tables)
    assert got == [("q", "nation.n_regionkey", "(rows)")] and len(plans) == 2  # the statement's, and n_regionkey erased
    assert len(proof.needed("SELECT *, COUNT(*) OVER () AS n FROM nation", {"nation": ["a", "b"]})) == 2


def test_erased_key_of_exists_meets_no_row(spark, sf_dir, monkeypatch):
    plans = _plans(monkeypatch)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders")}
    sql = "SELECT c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer"
    got = proof.influences(spark, [("q", sql)], tables)
    assert got == [("q", "customer.c_custkey", "big"), ("q", "customer.c_name", "c_name"), ("q", "orders.o_custkey", "big"), ("q", "orders.o_totalprice", "big")]
    assert len(plans) == 5 and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_erased_key_of_full_join_meets_no_row(spark, sf_dir, monkeypatch):
    plans = _plans(monkeypatch)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier")}
    got = proof.influences(spark, [("q", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey + 3")], tables)
    assert got == [("q", "customer.c_custkey", "(rows)"), ("q", "supplier.s_suppkey", "(rows)")]
    assert len(plans) == 3 and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


@pytest.mark.parametrize("run", sorted(proven.WHOLE))
def test_windows_over_all_rows_by_many_tasks(spark, sf_dir, run):
    query, column = run
    # repeated keys, gaps between them and rows without a key, state or price
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 1200 and o_orderkey % 200 < 120")
    odd = orders.where("o_orderkey % 9 = 0").selectExpr("IF(o_orderkey % 2 = 0, o_orderkey, NULL) AS o_orderkey", "o_custkey", "IF(o_custkey % 4 = 0, NULL, o_orderstatus) AS o_orderstatus", "IF(o_custkey % 3 = 0, NULL, o_totalprice) AS o_totalprice", "o_orderdate", "o_orderpriority")
    every = proof.erased(orders.unionByName(odd), column.partition(".")[2]).cache()
    every.createOrReplaceTempView("orders")
    try:
        want = spark.sql(dict(proven.batch("prove_windows")[0])[query])
        got = proven.WHOLE[run]({"orders": spark.table("orders")}).toDF(*want.columns)
        assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        plain, tables = proof.influences(spark, [(query, dict(proven.batch("prove_windows")[0])[query])], {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet")}), []
        note = {run: lambda t: (tables.append(t), proven.WHOLE[run](t))[1]}
        assert proof.influences(spark, [(query, dict(proven.batch("prove_windows")[0])[query])], {"orders": spark.read.parquet(f"{sf_dir}/orders.parquet")}, note) == plain and len(tables) == 1
    finally:
        spark.catalog.dropTempView("orders")
        every.unpersist()
