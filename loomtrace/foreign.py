"""Queries of statements in other dialects, run and held against the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions import surface
from .operators import proof
from .plans.dialects import spark_text
from .proven import TABLES

#: (dialect, statement, SQL of the oracle, outputs that are proven).
STATEMENTS: dict[str, tuple[str, str, str, str]] = {
    "dialect_paging": (
        "mysql",
        "SELECT STRAIGHT_JOIN c.c_name, t.o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders FORCE INDEX (PRIMARY) ORDER BY o_orderkey LIMIT 10, 500) t STRAIGHT_JOIN customer c ON t.o_custkey = c.c_custkey # a page",
        "SELECT c.c_name, t.o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 10) t JOIN customer c ON t.o_custkey = c.c_custkey",
        "",  # rows are another page where the ordering column is erased
    ),
    "dialect_modifiers": (
        "mysql",
        "SELECT SQL_NO_CACHE DISTINCTROW o.o_custkey, 'LIMIT 1, 2 # kept' AS said FROM customer c STRAIGHT_JOIN orders o IGNORE INDEX FOR JOIN (i_date) ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0 FOR UPDATE",
        "SELECT DISTINCT o.o_custkey, 'LIMIT 1, 2 # kept' AS said FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0",
        "o_custkey said",
    ),
    "dialect_group_concat": (
        "mysql",
        "SELECT c_nationkey, GROUP_CONCAT(DISTINCT c_mktsegment ORDER BY c_mktsegment SEPARATOR '; ') AS segments, GROUP_CONCAT(c_name, '/', c_mktsegment ORDER BY c_custkey DESC) AS names FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '; ' ORDER BY c_mktsegment) AS segments, string_agg(c_name || '/' || c_mktsegment, ',' ORDER BY c_custkey DESC) AS names FROM customer GROUP BY c_nationkey",
        "",  # lists of which only the order changes
    ),
    "dialect_casts": (
        "mysql",
        "SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS SIGNED INTEGER) AS whole, CONVERT(o_custkey + 1, CHAR) AS cust, CONVERT(o_orderpriority USING utf8mb4) AS priority, YEAR(CAST(o_orderdate AS DATETIME(6))) AS made FROM orders",
        "SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey + 1 AS VARCHAR) AS cust, o_orderpriority AS priority, CAST(YEAR(o_orderdate) AS INT) AS made FROM orders",
        "o_orderkey whole cust priority made",
    ),
    "dialect_join_hints": (
        "starrocks",
        "SELECT s.s_name, n.n_name FROM supplier s JOIN [broadcast] nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 1 || s.s_acctbal > 5000 && n.n_regionkey <> 2",
        "SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 1 OR s.s_acctbal > 5000 AND n.n_regionkey <> 2",
        "s_name n_name",
    ),
}


def query(name: str):
    dialect, sql, _, _ = STATEMENTS[name]
    return lambda spark, sf_dir: surface.run(spark, sf_dir, spark_text(sql, dialect))


def proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of the statements, held against what changes where a column is erased."""
    statements = [(n, spark_text(sql, dialect)) for n, (dialect, sql, _, outputs) in STATEMENTS.items() if outputs]
    words = " ".join(sql for _, sql in statements)
    return proof.prove(spark, statements, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words})


QUERIES = {n: query(n) for n in STATEMENTS} | {"prove_dialects": proven}
ORACLES = {n: x[2] for n, x in STATEMENTS.items()} | {"prove_dialects": proof.oracle([(n, x[2], x[3].split()) for n, x in STATEMENTS.items() if x[3]], TABLES)}
