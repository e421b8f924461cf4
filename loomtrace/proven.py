"""Queries that hold lineage against the given tables, and their SQL, in which another engine erases the same columns.

Each explains a batch of statements at once; its rows are what changed when a column was erased, with the lineage's verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import surface
from .operators import proof, ranged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Columns of the given tables (fixed values).
TABLES = {
    "region": "r_regionkey, r_name",
    "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props",
    "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label",
    "pages": "page_id, url, html",
    "labels": "doc_id, quality, toxic",
}

#: Outputs of the surface's statements, by the group that proves them.  Left out are statements over no table, those whose
#: outputs are constant, and windows of which only the rows' order changes.
GROUPS: dict[str, dict[str, str]] = {
    "prove_projections": {"select_columns": "o_orderkey o_orderstatus", "select_alias": "order_id status", "arithmetic_expr": "l_orderkey l_linenumber l_partkey l_suppkey commission q", "literal_column": "r_regionkey flag tag", "select_star": "n_nationkey n_name n_regionkey", "qualified_star": "n_nationkey n_name n_regionkey", "inline_comments": "r_regionkey r_name", "order_by": "o_orderkey o_totalprice", "order_limit_topk": "o_orderkey o_totalprice", "limit_offset": "o_orderkey"},
    "prove_filters": {"where_compare": "o_orderkey o_totalprice", "where_in": "o_orderkey", "where_between": "l_orderkey l_partkey l_quantity", "where_like": "p_partkey p_name", "where_null": "c_custkey o_orderkey", "partition_range_filter": "o_orderkey d", "having_filter": "o_custkey n", "derived_table": "k s", "nested_derived_table": "seg top", "cte_chain": "k s"},
    "prove_joins": {"inner_join": "o_orderkey c_name", "inner_join_multi_key": "l_orderkey l_partkey n", "left_join": "c_custkey o_orderkey", "right_join": "o_orderkey c_custkey", "full_join": "c_custkey s_suppkey", "cross_join": "r_name n_name", "implicit_join": "n_name r_name", "self_join": "x y", "join_derived": "c_custkey n", "join_ctes": "c_nationkey n", "theta_join": "x y", "join_using": "doc_id lang quality", "join_natural": "doc_id quality lang", "join_interval": "o_orderkey l_linenumber l_partkey l_suppkey", "semi_join": "c_custkey", "anti_join": "c_custkey"},
    "prove_aggregates": {"agg_sum": "l_returnflag revenue", "agg_count": "lang n s", "agg_count_distinct": "l_linestatus n", "agg_avg": "l_linestatus mean", "agg_min_max": "o_custkey lo hi", "agg_variance": "o_orderstatus v p", "agg_group_concat": "n_regionkey names", "agg_others": "l_returnflag sd high n mid last c", "group_by_ordinal": "o_orderstatus o_orderpriority n", "group_by_expr": "y n", "conditional_agg": "o_custkey n_open done", "agg_ratio": "l_returnflag unit", "select_distinct": "l_returnflag l_linestatus", "case_over_agg": "o_custkey size", "rollup_ext": "o_orderstatus o_orderpriority n", "grouping_sets_ext": "o_orderstatus o_orderpriority n"},
    "prove_windows": {"win_rank": "o_orderkey rk", "win_dense_rank": "o_orderkey rk", "win_percent_rank": "o_orderkey pr", "win_cume_dist": "o_orderkey cd", "win_sum_partition": "o_orderkey total", "win_range_frame": "o_orderkey near lo", "win_top_n_per_group": "o_custkey o_orderkey rn"},
    "prove_sets": {"union_all": "k", "union_distinct": "k", "intersect_op": "k", "except_op": "k", "union_tagged": "kind id name"},
    "prove_functions": {"fn_null_handling": "doc_id a b c", "fn_cast": "o_orderkey t i", "fn_string": "c_custkey a b t n r", "fn_math": "o_orderkey r f c a", "fn_date": "o_orderkey d m", "fn_date_arithmetic": "o_orderkey due days m q later first_day last_day", "fn_array": "vec_id n hi second has plus three", "fn_regexp": "page_id host shape paged part", "fn_if_case": "o_orderkey a b c", "fn_map_element": "event_id k"},
    "prove_generators": {"lateral_explode": "label n s", "fn_explode": "vec_id n top"},
    "prove_subqueries": {"scalar_subquery": "c_custkey top", "exists_subquery": "c_custkey", "in_subquery": "c_custkey"},
}

#: Further statements: (Spark SQL, SQL of the oracle or None where it is the same, outputs).
MORE: dict[str, dict[str, tuple[str, str | None, str]]] = {
    "prove_nested_scopes": {
        # both scopes have the name: the nearest wins
        "same_names": ("SELECT a.n_name, (SELECT MAX(n_nationkey) FROM nation WHERE n_regionkey = a.n_regionkey AND n_nationkey < a.n_nationkey) AS before FROM nation a", "SELECT a.n_name, (SELECT MAX(b.n_nationkey) FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey) AS before FROM nation a", "n_name before"),
        "two_levels": ("SELECT c_name, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > (SELECT MIN(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey)) AS n FROM customer", None, "c_name n"),
        "exists_output": ("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer", None, "c_custkey big"),
        "in_output": ("SELECT n_name, n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B') AS early FROM nation", None, "n_name early"),
        "not_in_filter": ("SELECT s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", None, "s_name"),
        "lateral": ("SELECT c.c_custkey, x.top, x.n FROM customer c, LATERAL (SELECT MAX(o_totalprice) AS top, COUNT(*) AS n FROM orders WHERE o_custkey = c.c_custkey) x", None, "c_custkey top n"),
        "lateral_chain": ("SELECT n.n_name, y.z FROM nation n, LATERAL (SELECT n.n_nationkey + 1 AS k) x, LATERAL (SELECT x.k * n.n_regionkey AS z) y", None, "n_name z"),
    },
    "prove_made_relations": {
        "values_join": ("SELECT n.n_name, v.label FROM nation n JOIN VALUES (0, 'zero'), (1, 'one'), (2, 'two') AS v(k, label) ON n.n_regionkey = v.k", "SELECT n.n_name, v.label FROM nation n JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) AS v(k, label) ON n.n_regionkey = v.k", "n_name label"),
        "range_join": ("SELECT r.id, c.c_name FROM range(5) r JOIN customer c ON c.c_nationkey = r.id", "SELECT r.range AS id, c.c_name FROM range(5) r JOIN customer c ON c.c_nationkey = r.range", "id c_name"),
        "lateral_explode_function": ("SELECT c.c_custkey, e.w FROM customer c, LATERAL explode(split(c.c_name, '0')) AS e(w)", "SELECT c_custkey, unnest(string_split(c_name, '0')) AS w FROM customer", "c_custkey w"),
        "table_aliases": ("SELECT d.a, d.b FROM nation AS d(k, a, b) WHERE d.k > 3", None, "a b"),
        "cte_aliases": ("WITH c(x, y) AS (SELECT n_name, n_regionkey FROM nation), d(p, q) AS (SELECT * FROM c) SELECT z.u, z.w + 1 AS w1 FROM d AS z(u, w)", None, "u w1"),
        "derived_aliases": ("SELECT x.k, SUM(x.v) AS s FROM (SELECT o_custkey, o_orderkey FROM orders) AS x(k, v) GROUP BY x.k", None, "k s"),
    },
    "prove_lambdas": {
        "outer_column": ("SELECT c_custkey, transform(split(c_name, '#'), e -> concat(e, c_mktsegment)) AS q FROM customer", "SELECT c_custkey, list_transform(string_split(c_name, '#'), lambda e: concat(e, c_mktsegment)) AS q FROM customer", "c_custkey q"),
        "nested": ("SELECT s_suppkey, transform(array(1, 2), a -> transform(array(s_nationkey), b -> a * b + s_suppkey)) AS q FROM supplier", "SELECT s_suppkey, list_transform([1, 2], lambda a: list_transform([s_nationkey], lambda b: a * b + s_suppkey)) AS q FROM supplier", "s_suppkey q"),
        "shadowed": ("SELECT n_nationkey, size(filter(array(1, 2, 3), n_regionkey -> n_regionkey > 1)) AS q, n_name FROM nation", "SELECT n_nationkey, len(list_filter([1, 2, 3], lambda k: k > 1)) AS q, n_name FROM nation", "n_nationkey q n_name"),
        "aggregated": ("SELECT l_orderkey, aggregate(array(l_quantity, l_tax), CAST(0 AS DOUBLE), (acc, x) -> acc + x * l_discount, acc -> acc + l_linenumber) AS q FROM lineitem", "SELECT l_orderkey, (l_quantity + l_tax) * l_discount + l_linenumber AS q FROM lineitem", "l_orderkey q"),
    },
    "prove_recursion": {
        # a tree of regions and nations: keys of regions are negative; names are carried down
        "tree": (
            "WITH RECURSIVE t(k, name, depth) AS (SELECT -1 - r_regionkey, r_name, 0 FROM region UNION ALL SELECT n.n_nationkey, concat(t.name, '/', n.n_name), t.depth + 1 FROM t JOIN nation n ON t.k = -1 - n.n_regionkey) SELECT k, name, depth FROM t",
            None, "k name depth",
        ),
        "counted": ("WITH RECURSIVE t(k, n) AS (SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT t.k, t.n + r.r_regionkey FROM t JOIN region r ON r.r_regionkey = t.n + 1) SELECT k, MAX(n) AS last FROM t GROUP BY k", None, "k last"),
    },
    "prove_reshaping": {
        "pivot": ("SELECT * FROM (SELECT c_nationkey, c_mktsegment, c_custkey FROM customer) PIVOT (SUM(c_custkey) AS s, COUNT(c_custkey) AS n FOR c_mktsegment IN ('BUILDING' AS b, 'MACHINERY' AS m))", "SELECT c_nationkey, sum(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS b_s, nullif(count(c_custkey) FILTER (c_mktsegment = 'BUILDING'), 0) AS b_n, sum(c_custkey) FILTER (c_mktsegment = 'MACHINERY') AS m_s, nullif(count(c_custkey) FILTER (c_mktsegment = 'MACHINERY'), 0) AS m_n FROM customer GROUP BY c_nationkey", "c_nationkey b_s b_n m_s m_n"),
        "unpivot": ("SELECT p_partkey, what, v FROM part UNPIVOT (v FOR what IN (p_brand AS brand, p_type))", "SELECT p_partkey, 'brand' AS what, p_brand AS v FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_type IS NOT NULL", "p_partkey what v"),
        "star_except": ("SELECT * EXCEPT (o_orderdate, o_orderpriority) FROM orders", "SELECT * EXCLUDE (o_orderdate, o_orderpriority) FROM orders", "o_orderkey o_custkey o_orderstatus o_totalprice"),
        "pipe": ("FROM orders |> WHERE o_totalprice > 100000 |> SELECT o_custkey, o_orderkey |> EXTEND o_orderkey + 1 AS k |> AGGREGATE SUM(k) AS s GROUP BY o_custkey", "SELECT o_custkey, SUM(o_orderkey + 1) AS s FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey", "o_custkey s"),
    },
}


def near_of_all(tables: dict[str, DataFrame]) -> DataFrame:
    """win_range_frame without customers: the counts of its first window's frames are those of ranges of keys; rows without a key are each other's frame."""
    o = tables["orders"].select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") - 2000).alias("first"))
    lost = F.lit(o.where("o_orderkey is null").count()).cast("bigint")
    found = ranged.range_counts(o, o, "o_orderkey", "first", "o_orderkey", "near").withColumn("near", F.when(F.col("o_orderkey").isNull(), lost).otherwise(F.col("near")))
    return found.selectExpr("o_orderkey", "near", "MIN(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 10 PRECEDING) AS lo")


def first_of_all(tables: dict[str, DataFrame]) -> DataFrame:
    """win_range_frame without states: the smallest key of its second window's frame is the next one from the frame's start on, if it is not behind the frame."""
    o = tables["orders"].select("o_orderkey", "o_custkey", (100 - F.col("o_orderkey")).alias("at"))
    keys = tables["orders"].select((-F.col("o_orderkey")).alias("at"), F.col("o_orderkey").alias("key"))
    found = ranged.as_of_join(o, keys, [], "at", "key", "lo")
    return found.selectExpr("o_orderkey", "COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW) AS near", "IF(lo <= o_orderkey - 10, lo, NULL) AS lo")


def total_of_all(tables: dict[str, DataFrame]) -> DataFrame:
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    return tables["orders"].select("o_orderkey").crossJoin(F.broadcast(tables["orders"].agg(price)))


def ranked(by: str, how: str):
    return lambda tables: ranged.ranks(tables["orders"].select("o_orderkey", by), by).select("o_orderkey", how)


#: Runs whose windows are left with all rows by the column that is erased: the same rows, made by many tasks.
WHOLE = {
    ("win_rank", "orders.o_custkey"): ranked("o_orderstatus", "rank"),
    ("win_dense_rank", "orders.o_custkey"): ranked("o_orderpriority", "dense_rank"),
    ("win_percent_rank", "orders.o_custkey"): ranked("o_totalprice", "percent_rank"),
    ("win_cume_dist", "orders.o_custkey"): ranked("o_totalprice", "cume_dist"),
    ("win_sum_partition", "orders.o_custkey"): total_of_all,
    ("win_range_frame", "orders.o_custkey"): near_of_all,
    ("win_range_frame", "orders.o_orderstatus"): first_of_all,
}


def batch(name: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, list[str]]]]:
    """The statements of a group for Spark, and for the oracle with their outputs."""
    spark, other = [], []
    for q, outputs in GROUPS.get(name, {}).items():
        s = surface.STATEMENTS[q]
        own, sql = (s, s) if isinstance(s, str) else (s[0], s[1] or s[0])
        spark.append((q, own))
        other.append((q, sql, outputs.split()))
    for q, (own, sql, outputs) in MORE.get(name, {}).items():
        spark.append((q, own))
        other.append((q, sql or own, outputs.split()))
    return spark, other


def register(name: str) -> None:
    statements, other = batch(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = " ".join(sql for _, sql in statements)
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words}
        return proof.prove(spark, statements, tables, whole=WHOLE)

    QUERIES[name] = run
    ORACLES[name] = proof.oracle(other, TABLES)


#: Statements that write: (SQL, columns of the targets that are there before; partition columns after a bar).
WRITES: dict[str, tuple[str, dict[str, str]]] = {
    "positional": ("INSERT INTO {t1} SELECT o_custkey, upper(o_orderstatus), o_orderkey + o_custkey FROM orders WHERE o_orderkey > 10", {"t1": "cust bigint, status string, both bigint"}),
    "listed": ("INSERT INTO {t2} (b, a) SELECT n_name, n_nationkey FROM nation", {"t2": "a int, b string"}),
    "named": ("INSERT INTO {t3} BY NAME SELECT r_name AS name, r_regionkey AS k FROM region", {"t3": "k int, name string"}),
    "made": ("CREATE TABLE {t4} USING parquet AS WITH c(k, s) AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT k, s AS segment, 1 AS one FROM c", {}),
    "several": ("FROM customer INSERT INTO {t5} SELECT c_custkey, c_mktsegment WHERE c_custkey > 50 INSERT INTO {t6} SELECT c_name, c_nationkey", {"t5": "k bigint, s string", "t6": "n string, k int"}),
    "partition": ("INSERT OVERWRITE TABLE {t7} PARTITION (seg = 'x') SELECT s_suppkey, s_name FROM supplier", {"t7": "k bigint, n string, seg string|seg"}),
}
#: What stands in the written columns: (query_id, target, sources, value, FROM clause).
WRITTEN = [
    ("positional", "t1.cust", "orders.o_custkey", "o_custkey", "orders WHERE o_orderkey > 10"), ("positional", "t1.status", "orders.o_orderstatus", "upper(o_orderstatus)", "orders WHERE o_orderkey > 10"),
    ("positional", "t1.both", "orders.o_custkey, orders.o_orderkey", "o_orderkey + o_custkey", "orders WHERE o_orderkey > 10"),
    ("listed", "t2.b", "nation.n_name", "n_name", "nation"), ("listed", "t2.a", "nation.n_nationkey", "n_nationkey", "nation"),
    ("named", "t3.name", "region.r_name", "r_name", "region"), ("named", "t3.k", "region.r_regionkey", "r_regionkey", "region"),
    ("made", "t4.k", "customer.c_custkey", "c_custkey", "customer"), ("made", "t4.segment", "customer.c_mktsegment", "c_mktsegment", "customer"), ("made", "t4.one", "", "1", "customer"),
    ("several", "t5.k", "customer.c_custkey", "c_custkey", "customer WHERE c_custkey > 50"), ("several", "t5.s", "customer.c_mktsegment", "c_mktsegment", "customer WHERE c_custkey > 50"),
    ("several", "t6.n", "customer.c_name", "c_name", "customer"), ("several", "t6.k", "customer.c_nationkey", "c_nationkey", "customer"),
    ("partition", "t7.k", "supplier.s_suppkey", "s_suppkey", "supplier"), ("partition", "t7.n", "supplier.s_name", "s_name", "supplier"),
]
MERGE = """MERGE INTO supplier t USING (SELECT c_custkey AS k, c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey > 5) s ON t.s_suppkey = s.k
WHEN MATCHED AND s.b > t.s_acctbal THEN UPDATE SET s_acctbal = s.b - t.s_acctbal, s_name = s.n
WHEN MATCHED AND s.b < 0 THEN DELETE
WHEN NOT MATCHED AND s.k < 500 THEN INSERT (s_suppkey, s_name) VALUES (s.k, s.n)
WHEN NOT MATCHED BY SOURCE THEN UPDATE SET s_acctbal = 0"""


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "nation", "region", "customer", "supplier")}
    return proof.written(spark, [(q, sql, targets) for q, (sql, targets) in WRITES.items()], tables)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proof.merge_counts(spark, [("merge", MERGE)], {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier")})


QUERIES |= {"write_columns": written, "write_merge_actions": merged}
ORACLES["write_columns"] = " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{t}' AS target, '{s}' AS sources, count({v}) AS n_values, CAST(sum(length(CAST({v} AS VARCHAR))) AS BIGINT) AS width FROM {f}" for q, t, s, v, f in WRITTEN)
ORACLES["write_merge_actions"] = """
WITH s AS (SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_custkey > 5), m AS (SELECT s.b, t.s_acctbal AS a FROM supplier t JOIN s ON t.s_suppkey = s.k),
n AS (SELECT count(*) FILTER (b > a) AS updated, count(*) FILTER (b < 0 AND NOT coalesce(b > a, FALSE)) AS deleted FROM m),
i AS (SELECT count(*) AS inserted FROM s WHERE k < 500 AND k NOT IN (SELECT s_suppkey FROM supplier)), o AS (SELECT count(*) AS other FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM s))
SELECT 'merge' AS query_id, unnest(['merge_update', 'merge_update', 'merge_delete', 'merge_insert', 'merge_insert', 'merge_update']) AS action,
  unnest(['supplier.s_acctbal', 'supplier.s_name', 'supplier', 'supplier.s_suppkey', 'supplier.s_name', 'supplier.s_acctbal']) AS target,
  unnest(['customer.c_acctbal, supplier.s_acctbal', 'customer.c_name', '', 'customer.c_custkey', 'customer.c_name', '']) AS sources,
  unnest([updated, updated, deleted, inserted, inserted, other]) AS n_rows FROM n, i, o"""

for _name in (*GROUPS, *MORE):
    register(_name)
