"""The SQL surface that the analyzer explains, executed: one statement for each construct.

Each entry is (Spark SQL, SQL for the oracle or None where the text is the same).  Spark plans them; nothing here schedules
work.  Sums of money are sums of decimals, so that their value doesn't depend on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables of sf_dir that it names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def money(x: str, name: str, how: str = "SUM") -> str:
    return f"CAST({how}(CAST({x} AS DECIMAL(18,4))) AS DOUBLE) AS {name}"


NET = "l_extendedprice * (1 - l_discount)"

STATEMENTS: dict[str, str | tuple[str, str]] = {
    # projections, filters, predicates
    "select_columns": "SELECT o_orderkey, o_orderstatus FROM orders",
    "select_alias": "SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders",
    "arithmetic_expr": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * 0.1 AS commission, l_quantity + 1 - l_tax AS q FROM lineitem",
    "literal_column": "SELECT r_regionkey, CAST(1 AS BIGINT) AS flag, 'x' AS tag FROM region",
    "select_star": "SELECT * FROM nation",
    "qualified_star": "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'",
    "where_compare": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' OR o_orderkey = 7",
    "where_in": "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "where_between": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "where_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%ECO%' OR p_name LIKE 'b%t'",
    "where_null": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT' WHERE o.o_orderkey IS NULL AND c.c_name IS NOT NULL",
    "partition_range_filter": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
    "having_filter": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5",
    "derived_table": "SELECT x.k, x.s FROM (SELECT o_custkey AS k, COUNT(*) AS s FROM orders GROUP BY o_custkey) x WHERE x.s > 3",
    "nested_derived_table": f"SELECT y.seg, MAX(y.s) AS top FROM (SELECT c.c_mktsegment AS seg, x.s FROM (SELECT o_custkey AS k, {money('o_totalprice', 's')} FROM orders GROUP BY o_custkey) x JOIN customer c ON c.c_custkey = x.k) y GROUP BY y.seg",
    "cte_chain": f"WITH a AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT a.o_custkey AS k, {money('l.l_extendedprice', 's')} FROM a JOIN lineitem l ON a.o_orderkey = l.l_orderkey GROUP BY a.o_custkey), c AS (SELECT k, s FROM b WHERE s > 1000) SELECT k, s FROM c",
    "recursive_cte": "WITH RECURSIVE t(k, n) AS (SELECT CAST(r_regionkey AS BIGINT), CAST(0 AS BIGINT) FROM region UNION ALL SELECT k * 2 + 1, n + 1 FROM t WHERE n < 15) SELECT k, n FROM t",
    "scalar_subquery": "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "exists_subquery": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "lateral_explode": ("SELECT label, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CAST(e AS DECIMAL(18,6))) AS DOUBLE) AS s FROM embeddings LATERAL VIEW explode(embedding) t AS e GROUP BY label", "SELECT label, COUNT(*) AS n, CAST(SUM(CAST(e AS DECIMAL(18,6))) AS DOUBLE) AS s FROM (SELECT label, unnest(embedding) AS e FROM embeddings) GROUP BY label"),
    "hint_distribute": ("SELECT /*+ BROADCAST(r) */ n_nationkey, r_name FROM nation JOIN region r ON n_regionkey = r_regionkey DISTRIBUTE BY n_nationkey", "SELECT n_nationkey, r_name FROM nation JOIN region r ON n_regionkey = r_regionkey"),
    "from_less": "SELECT r_regionkey, x.one, x.letter FROM region CROSS JOIN (SELECT CAST(1 AS BIGINT) AS one, 'a' AS letter) x",
    "quoted_names": ("SELECT r_regionkey AS `区域`, r_name AS `name of it` FROM region", 'SELECT r_regionkey AS "区域", r_name AS "name of it" FROM region'),
    "inline_comments": "SELECT /* the key */ r_regionkey, -- its name\n r_name FROM region",
    # joins
    "inner_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "inner_join_multi_key": "SELECT a.l_orderkey, a.l_partkey, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey GROUP BY a.l_orderkey, a.l_partkey",
    "left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
    "right_join": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey",
    "full_join": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey + 50",
    "cross_join": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "implicit_join": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "self_join": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_derived": "SELECT c.c_custkey, x.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) x ON c.c_custkey = x.o_custkey",
    "join_ctes": "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey, c_nationkey FROM customer) SELECT b.c_nationkey, CAST(SUM(a.n) AS BIGINT) AS n FROM a JOIN b ON a.o_custkey = b.c_custkey GROUP BY b.c_nationkey",
    "theta_join": "SELECT a.r_name AS x, b.n_name AS y FROM region a JOIN nation b ON a.r_regionkey > b.n_regionkey OR b.n_nationkey = 3",
    "join_using": "SELECT doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)",
    "join_natural": "SELECT doc_id, quality, lang FROM documents NATURAL JOIN labels",
    "join_interval": "SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 60 DAYS",
    "join_as_of": (
        "SELECT event_id, before FROM (SELECT event_id, event_type, LAST_VALUE(CASE WHEN event_type = 'view' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS r FROM events) x WHERE r = 1) y WHERE event_type = 'purchase'",
        "WITH x AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS r FROM events) WHERE r = 1) SELECT p.event_id, v.event_id AS before FROM (SELECT * FROM x WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM x WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts",
    ),
    "semi_join": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "anti_join": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'"),
    # aggregates
    "agg_sum": f"SELECT l_returnflag, {money(NET, 'revenue')} FROM lineitem GROUP BY l_returnflag",
    "agg_count": "SELECT lang, COUNT(*) AS n, COUNT(source) AS s FROM documents GROUP BY lang",
    "agg_count_distinct": "SELECT l_shipdate, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_shipdate" .replace("l_shipdate", "l_linestatus"),
    "agg_avg": "SELECT l_linestatus, ROUND(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS mean FROM lineitem GROUP BY l_linestatus",
    "agg_min_max": "SELECT o_custkey, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders GROUP BY o_custkey",
    "agg_variance": ("SELECT o_orderstatus, ROUND(VARIANCE(o_totalprice), 0) AS v, ROUND(VAR_POP(o_totalprice), 0) AS p FROM orders GROUP BY o_orderstatus", None),
    "agg_group_concat": ("SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_approx_distinct": (
        "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, ABS(APPROX_COUNT_DISTINCT(o_custkey) - COUNT(DISTINCT o_custkey)) <= 0.2 * COUNT(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, TRUE AS near FROM orders GROUP BY o_orderstatus",
    ),
    "agg_others": (
        "SELECT l_returnflag, ROUND(STDDEV_POP(l_quantity), 4) AS sd, BOOL_OR(l_tax > 0.079) AS high, COUNT_IF(l_discount > 0.05) AS n, MEDIAN(l_quantity) AS mid, MAX_BY(l_orderkey, l_orderkey * 10 + l_linenumber) AS last, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(STDDEV_POP(l_quantity), 4) AS sd, BOOL_OR(l_tax > 0.079) AS high, CAST(COUNT_IF(l_discount > 0.05) AS BIGINT) AS n, MEDIAN(l_quantity) AS mid, MAX_BY(l_orderkey, l_orderkey * 10 + l_linenumber) AS last, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
    ),
    "group_by_ordinal": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2",
    "group_by_expr": ("SELECT year(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders GROUP BY 1"),
    "conditional_agg": f"SELECT o_custkey, COUNT(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS n_open, {money('o_totalprice * CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN 1 ELSE 0 END', 'done')} FROM orders GROUP BY o_custkey",
    "agg_ratio": "SELECT l_returnflag, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 6) AS unit FROM lineitem GROUP BY l_returnflag",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "case_over_agg": "SELECT o_custkey, CASE WHEN COUNT(*) > 10 THEN 'many' ELSE 'few' END AS size FROM orders GROUP BY o_custkey",
    "rollup_ext": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)", None),
    "cube_ext": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", None),
    "grouping_sets_ext": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))",
    # windows
    "win_row_number": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank": "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk FROM orders",
    "win_dense_rank": "SELECT o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk FROM orders",
    "win_percent_rank": "SELECT o_orderkey, PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS pr FROM orders",
    "win_cume_dist": "SELECT o_orderkey, CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS cd FROM orders",
    "win_ntile": "SELECT o_orderkey, CAST(NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS q FROM orders",
    "win_lead_lag": "SELECT o_orderkey, LAG(o_totalprice) OVER w AS before, LEAD(o_totalprice, 1, 0.0) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_first_last_nth": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_sum_partition": "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total FROM orders",
    "win_running_min_max": ("SELECT o_orderkey, IF(o_totalprice = MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 1, 0) AS is_top, MIN(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS lo FROM orders", None),
    "win_top_n_per_group": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) t WHERE rn <= 3",
    "win_rows_frame": "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM orders",
    "win_range_frame": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW) AS near, MIN(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 10 PRECEDING) AS lo FROM orders",
    # sort and limit (the features themselves)
    "order_by": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
    "order_limit_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 10",
    # set operations
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_op": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_op": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000 OR s_nationkey < 5",
    "union_tagged": "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier",
    # scalar functions
    "fn_null_handling": ("SELECT doc_id, COALESCE(NULLIF(lang, 'en'), 'none') AS a, IFNULL(NULLIF(source, 'src0'), '-') AS b, NVL(NULLIF(lang, 'fr'), 'x') AS c FROM documents", "SELECT doc_id, COALESCE(NULLIF(lang, 'en'), 'none') AS a, IFNULL(NULLIF(source, 'src0'), '-') AS b, COALESCE(NULLIF(lang, 'fr'), 'x') AS c FROM documents"),
    "fn_cast": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR(30)) AS t, CAST(o_orderkey AS INT) AS i FROM orders",
    "fn_string": "SELECT c_custkey, CONCAT(UPPER(c_name), '-', LOWER(c_mktsegment)) AS a, SUBSTR(c_name, 1, 5) AS b, TRIM(c_mktsegment) AS t, CAST(LENGTH(c_name) AS BIGINT) AS n, REPLACE(c_name, '0', 'o') AS r FROM customer",
    "fn_math": "SELECT o_orderkey, ROUND(o_totalprice, 1) AS r, CAST(FLOOR(o_totalprice) AS BIGINT) AS f, CAST(CEIL(o_totalprice) AS BIGINT) AS c, ABS(0 - o_totalprice) AS a FROM orders",
    "fn_date": ("SELECT o_orderkey, CAST(DATE(o_orderdate) AS VARCHAR(10)) AS d, DATE_FORMAT(o_orderdate, 'yyyy-MM') AS m FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS d, strftime(o_orderdate, '%Y-%m') AS m FROM orders"),
    "fn_date_arithmetic": (
        "SELECT o_orderkey, CAST(date_add(o_orderdate, 30) AS STRING) AS due, CAST(datediff(o_orderdate, DATE '1995-01-01') AS BIGINT) AS days, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(CAST(add_months(o_orderdate, 2) AS DATE) AS STRING) AS later, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS first_day, CAST(last_day(o_orderdate) AS STRING) AS last_day FROM orders",
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, month(o_orderdate) AS m, quarter(o_orderdate) AS q, CAST(CAST(o_orderdate + INTERVAL 2 MONTHS AS DATE) AS VARCHAR) AS later, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(last_day(o_orderdate) AS VARCHAR) AS last_day FROM orders",
    ),
    "fn_now": "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) < CURRENT_DATE AND NOW() IS NOT NULL AND CURRENT_TIMESTAMP IS NOT NULL GROUP BY o_orderstatus",
    "fn_json": ("SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.none') AS none, to_json(named_struct('id', event_id)) AS j FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none, CAST(json_object('id', event_id) AS VARCHAR) AS j FROM events"),
    "fn_array": ("SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, array_max(embedding) AS hi, element_at(embedding, 2) AS second, array_contains(embedding, embedding[2]) AS has, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS plus, CAST(size(slice(embedding, 2, 3)) AS BIGINT) AS three FROM embeddings", "SELECT vec_id, len(embedding) AS n, list_max(embedding) AS hi, embedding[2] AS second, list_contains(embedding, embedding[3]) AS has, len(list_filter(embedding, lambda x: x > 0)) AS plus, len(embedding[2:4]) AS three FROM embeddings"),
    "fn_regexp": ("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#') AS shape, url RLIKE 'page=[0-9]' AS paged, split_part(url, '/', 3) AS part FROM pages", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS shape, regexp_matches(url, 'page=[0-9]') AS paged, split_part(url, '/', 3) AS part FROM pages"),
    "fn_if_case": "SELECT o_orderkey, IF(o_totalprice > 100000, 'big', 'small') AS a, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS b, CASE WHEN o_totalprice > 200000 THEN 'x' END AS c FROM orders",
    "fn_map_element": ("SELECT event_id, from_json(props, 'map<string,int>')['k'] AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "fn_explode": ("SELECT vec_id, CAST(COUNT(e) AS BIGINT) AS n, MAX(e) AS top FROM (SELECT vec_id, explode(embedding) AS e FROM embeddings) GROUP BY vec_id", "SELECT vec_id, COUNT(e) AS n, MAX(e) AS top FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings) GROUP BY vec_id"),
    "fn_try_cast": "SELECT doc_id, TRY_CAST(lang AS INT) AS i, TRY_CAST(SUBSTR(CAST(doc_id AS VARCHAR(20)), 1, 2) AS INT) AS two, TRY_CAST(CAST(n_chars AS VARCHAR(20)) AS BIGINT) AS n FROM documents",
    # what the semantics report claims, measured on data
    "measure_join_fanout": "SELECT ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM customer), 6) AS fanout FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
    "measure_grain_unique": "SELECT COUNT(*) AS row_count, COUNT(DISTINCT o_orderkey) AS keys, COUNT(*) = COUNT(DISTINCT o_orderkey) AS is_unique FROM orders",
    "measure_key_uniqueness": "SELECT COUNT(*) AS repeated_keys FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) t",
}



def query(name: str):
    s = STATEMENTS[name]
    sql = s if isinstance(s, str) else s[0]
    return lambda spark, sf_dir: run(spark, sf_dir, sql)


def insert_select_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT INTO a managed table, then its rows."""
    import uuid

    name = f"insert_roundtrip_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} (r_regionkey INT, r_name STRING) USING parquet")
    run(spark, sf_dir, f"INSERT INTO {name} SELECT r_regionkey, UPPER(r_name) FROM region")
    return spark.sql(f"SELECT r_regionkey, r_name FROM {name}")


QUERIES = {n: query(n) for n in STATEMENTS} | {"insert_select_roundtrip": insert_select_roundtrip}
ORACLES = {n: s if isinstance(s, str) else s[1] or s[0] for n, s in STATEMENTS.items()} | {"insert_select_roundtrip": "SELECT r_regionkey, UPPER(r_name) AS r_name FROM region"}
