"""Queries that measure on the given tables what joins, grains and sketches claim, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sketches
from .operators import measured, ranged
from .shared import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- joins on ranges ---


def range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balance lies within a supplier's; the suppliers' ranges are of very different widths."""
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + F.pow(F.col("s_suppkey") % 9, F.lit(3))).alias("high"))
    return ranged.range_join(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), supplier, "c_acctbal", "low", "high").select("c_custkey", "s_suppkey")


def range_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders' prices lie in each part's price band: the bands overlap, and only their numbers of orders are made."""
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - 1).alias("low"), (F.col("p_retailprice") + F.col("p_size")).alias("high"))
    found = ranged.range_counts(read(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100).alias("price")), part, "price", "low", "high")
    return found.where("n > 0").groupBy("p_partkey").agg(F.sum("n").alias("n"))


def as_of(name: str, keys: list[str], strict: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = read(spark, sf_dir, "events")
        views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
        rest = e.where("event_type <> 'view'").select("event_id", "user_id", "ts")
        return ranged.as_of_join(rest, views, keys, "ts", "view_id", "view_id", strict).select("event_id", "view_id")

    on = "".join(f" AND l.{k} = r.{k}" for k in keys)
    QUERIES[name] = run
    # of views of one time the last: made one row for each time first
    ORACLES[name] = f"""WITH v AS (SELECT {''.join(k + ', ' for k in keys)}ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT l.event_id, r.view_id FROM events l ASOF LEFT JOIN v r ON l.ts {'>' if strict else '>='} r.ts{on} WHERE l.event_type <> 'view'"""


QUERIES |= {"join_range": range_pairs, "join_range_bands": range_discounts}
ORACLES["join_range"] = "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal AND s_acctbal + (s_suppkey % 9) ** 3"
ORACLES["join_range_bands"] = "SELECT p_partkey, COUNT(*) AS n FROM orders JOIN part ON o_totalprice / 100 BETWEEN p_retailprice - 1 AND p_retailprice + p_size GROUP BY p_partkey"
as_of("join_as_of_keyed", ["user_id"], False)
as_of("join_as_of_unkeyed", [], True)

# --- sketches ---


def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each order status: exact, and by sketches of the parts that are stored, added to, read again and merged."""
    orders = read(spark, sf_dir, "orders")
    path = f"{shared_folder(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    for piece in (orders.where(old), orders.where(~old)):
        kept = sketches.stored(spark, sketches.sketches(piece, ["o_orderstatus"], "o_custkey"), path)
    exact = orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_exact"))
    near = F.abs(F.col("estimate") - F.col("n_exact")) <= 0.05 * F.col("n_exact")
    by_group = exact.join(sketches.estimates(kept, ["o_orderstatus"]), "o_orderstatus").select("o_orderstatus", "n_exact", near.alias("within_5_percent"))
    whole = sketches.estimates(kept.withColumn("o_orderstatus", F.lit("all")), ["o_orderstatus"])
    total = orders.agg(F.count_distinct("o_custkey").alias("n_exact")).withColumn("o_orderstatus", F.lit("all"))
    return by_group.unionByName(total.join(whole, "o_orderstatus").select("o_orderstatus", "n_exact", near.alias("within_5_percent")))


QUERIES["agg_distinct_sketches"] = distinct_sketches
ORACLES["agg_distinct_sketches"] = "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n_exact, TRUE AS within_5_percent FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'all', COUNT(DISTINCT o_custkey), TRUE FROM orders"

# --- measured joins and grains ---

JOINS = [
    ("one_to_many", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"),
    ("many_to_many", "SELECT c.c_name, s.s_name FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey"),
    ("chain", "SELECT r.r_name, n.n_name, c.c_name FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey"),
    ("two_keys", "WITH l AS (SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber) SELECT COUNT(*) AS n FROM l"),
    ("one_to_one", "SELECT d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)"),
]
#: (query, left, right): tables and columns of each join, by query and left key.
SIDES = [
    ("chain", "customer c_nationkey", "nation n_nationkey"), ("chain", "region r_regionkey", "nation n_regionkey"), ("many_to_many", "customer c_nationkey", "supplier s_nationkey"),
    ("one_to_many", "customer c_custkey", "orders o_custkey"), ("one_to_one", "documents doc_id", "labels doc_id"), ("two_keys", "lineitem l_orderkey l_linenumber", "lineitem l_orderkey l_linenumber"),
]


def joins_sql() -> str:
    parts = []
    for q, left, right in SIDES:
        (lt, *lc), (rt, *rc) = left.split(), right.split()
        group = lambda t, cs: f"SELECT {', '.join(f'{c} AS k{i}' for i, c in enumerate(cs))}, count(*) AS n FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)} GROUP BY ALL"
        same = " AND ".join(f"l.k{i} = r.k{i}" for i in range(len(lc)))
        names = [", ".join(f"{t}.{c}" for c in cs) for t, cs in ((lt, lc), (rt, rc))]
        parts.append(f"""SELECT '{q}' AS query_id, '{names[0]}' AS left_key, '{names[1]}' AS right_key, (SELECT sum(n) FROM ({group(lt, lc)})) AS left_rows, (SELECT count(*) FROM ({group(lt, lc)})) AS left_keys,
  (SELECT sum(n) FROM ({group(rt, rc)})) AS right_rows, (SELECT count(*) FROM ({group(rt, rc)})) AS right_keys, (SELECT sum(l.n * r.n) FROM ({group(lt, lc)}) l JOIN ({group(rt, rc)}) r ON {same}) AS joined_rows,
  (SELECT CAST(max(n) > 1 AS INT) FROM ({group(lt, lc)})) + (SELECT CAST(max(n) > 1 AS INT) FROM ({group(rt, rc)})) AS repeated""")
    return "SELECT query_id, left_key, right_key, CAST(left_rows AS BIGINT) AS left_rows, left_keys, CAST(right_rows AS BIGINT) AS right_rows, right_keys, CAST(joined_rows AS BIGINT) AS joined_rows, ['low', 'medium', 'high'][repeated + 1] AS risk, ['info', 'warning', 'error'][repeated + 1] AS level FROM (" + " UNION ALL ".join(parts) + ")"


def joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: read(spark, sf_dir, t) for t in ("customer", "orders", "supplier", "region", "nation", "lineitem", "documents", "labels")}
    return measured.measured_joins(spark, JOINS, tables)


GRAINS = [
    ("detail", "SELECT o_orderkey, o_custkey FROM orders", "detail", "o_orderkey, o_custkey"),
    ("repeated", "SELECT o_custkey, o_orderstatus FROM orders", "detail", "o_custkey, o_orderstatus"),
    ("grouped", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey", "group_by", "o_custkey"),
    ("by_number", "SELECT o_orderstatus, o_orderpriority, MAX(o_totalprice) AS top FROM orders GROUP BY 1, 2", "group_by", "o_orderstatus, o_orderpriority"),
    ("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", "distinct", "c_nationkey, c_mktsegment"),
    ("window", "SELECT l_orderkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem", "window_partition", "l_orderkey"),
]


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")}
    return measured.measured_grains(spark, [(q, sql) for q, sql, _, _ in GRAINS], tables)


QUERIES |= {"measured_joins": joins, "measured_grains": grains}
ORACLES["measured_joins"] = joins_sql()
ORACLES["measured_grains"] = " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{kind}' AS grain_type, COUNT(*) AS n_rows, COUNT(DISTINCT ({columns})) AS n_groups, COUNT(*) = COUNT(DISTINCT ({columns})) AS is_unique FROM ({sql}) x" for q, sql, kind, columns in GRAINS)
