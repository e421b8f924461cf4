"""Lineage held against data: a column is erased, the statement runs again, and what changes must be what lineage says.

Of every statement and every column that it may read, one run has the column null in all rows.  A run is reduced where it runs to
one row: the number of rows and a digest of every output (sums of hashes; for floating-point outputs counts and sums, compared with
a tolerance).  The column changes an output, or the number of rows; the statement's lineage explains that by an edge to the
output, or by the column deciding over rows (filters, join keys, groups, ...).

A key that is known to be null leaves some joins (full ones, EXISTS as an output) without equality, so that Spark compares all
rows with all.  Where a run's plan has such a loop that the statement's own hasn't, the nulls are made row by row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parsed import parse
from ..shared import copy_settings, small_table
from ..sources import catalog
from .analysis import ROOT, Analysis

#: The target of columns that change the number of rows.
ROWS = "(rows)"
#: Runs at a time; the relative difference of sums of floating-point numbers that counts as none.
THREADS, TOLERANCE = 8, 1e-9


def read(sql: str, tables: dict[str, list[str]]) -> list[tuple[str, str]]:
    """The columns that a statement may read: those whose name it has, all of its tables' if it has a star, a natural join or columns that are renamed by place."""
    words = set(re.findall(r"\w+", sql.lower()))
    every = re.search(r"(?i)(?:^|[^\w)\s]|select|distinct|\.)\s*\*|natural|\bas\s+\w+\s*\(", sql) is not None
    return [(t, c) for t, columns in tables.items() if t in words for c in columns if every or c.lower() in words]


def needed(sql: str, tables: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Those of read() whose erasure can show: COUNT(*) is no star, it reads no column."""
    return read(re.sub(r"(?i)\bcount\s*\(\s*\*\s*\)", "count(1)", sql), tables)


def erased(df: DataFrame, column: str, hidden: bool = False) -> DataFrame:
    """df with the column null in all rows; ``hidden``: without the optimizer knowing that it is."""
    if hidden:
        return df.withColumn(column, F.when(F.length(F.col(column).cast("string")) < 0, F.col(column)))
    return df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))


def loops(spark: SparkSession, sql: str) -> tuple[int, bool]:
    """How many joins of a statement's plan compare all rows with all, and whether it has a join."""
    text = spark.sql(f"EXPLAIN {sql}").first()[0]
    return len(re.findall("NestedLoopJoin|CartesianProduct", text)), "Join" in text


#: Bits of a hash that are summed on their own: such sums are whole numbers of 64 bits for up to 2**41 rows.
PIECES = ((0, 22), (22, 21), (43, 21))


def digest(df: DataFrame) -> DataFrame:
    """One row: n, and of each output how many values there are, sums of pieces of hashes, a sum and a sum of squares."""
    plain = df.toDF(*[f"o{i}" for i in range(len(df.columns))])
    out = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(plain.schema):
        number = f.dataType.simpleString() in ("float", "double")
        x = F.col(f.name)
        pieces = [F.sum(F.shiftrightunsigned(F.xxhash64(x), at).bitwiseAND(2**bits - 1)) for at, bits in PIECES]
        values = [F.lit(0), F.sum(x), F.sum(x * x)] if number else [F.array(*pieces), F.lit(0.0), F.lit(0.0)]
        out += [F.count(x).alias(f"c{i}"), *[v.alias(f"{n}{i}") for n, v in zip("hsq", values, strict=True)]]
    return plain.agg(*out)


def differ(a, b, i: int) -> bool:
    far = lambda x, y: (x is None) != (y is None) or x is not None and abs(x - y) > TOLERANCE * max(abs(x), abs(y), 1e-300)
    return a[f"c{i}"] != b[f"c{i}"] or a[f"h{i}"] != b[f"h{i}"] or far(a[f"s{i}"], b[f"s{i}"]) or far(a[f"q{i}"], b[f"q{i}"])


def influences(spark: SparkSession, statements: list[tuple[str, str]], tables: dict[str, DataFrame], whole: dict[tuple[str, str], Callable] | None = None) -> list[tuple[str, str, str]]:
    """(query_id, table.column, output or ROWS) for each column whose erasure changes it.

    ``whole``: (query_id, table.column) -> what makes the statement's rows of the tables with this column erased in another way; for windows that are left with all rows, which Spark brings into one task."""
    whole = whole or {}
    own = isolated(spark, tables)
    names = {t: df.columns for t, df in tables.items()}
    views = lambda t, df: df.createOrReplaceTempView(t)
    plain = {t: own.table(t) for t in tables}
    runs = []
    with ThreadPoolExecutor(THREADS) as pool:  # each run gives the driver one row
        start = lambda q, c, df, make=lambda df: df: runs.append((q, c, df.columns, pool.submit(lambda: digest(make(df)).first())))
        for q, sql in statements:
            start(q, None, own.sql(sql))
            usual, joins = loops(own, sql)
            for t, c in needed(sql, names):
                views(t, erased(plain[t], c))
                if joins and loops(own, sql)[0] > usual:
                    views(t, erased(plain[t], c, hidden=True))
                if (q, f"{t}.{c}") in whole:
                    start(q, f"{t}.{c}", own.sql(sql), lambda df, made=whole[q, f"{t}.{c}"], now={x: own.table(x) for x in tables}: made(now).toDF(*df.columns))
                else:
                    start(q, f"{t}.{c}", own.sql(sql))
                views(t, plain[t])
        found = [(q, c, outputs, row.result()) for q, c, outputs, row in runs]
    base = {q: row for q, c, _, row in found if c is None}
    out = []
    for q, c, outputs, row in found:
        if c is None:
            continue
        first = base[q]
        if row.n != first.n:
            out.append((q, c, ROWS))
        else:
            out += [(q, c, name) for i, name in enumerate(outputs) if differ(row, first, i)]
    spark.createDataFrame([], "none int")  # the caller's session is the active one again
    return sorted(set(out))


def prove(spark: SparkSession, statements: list[tuple[str, str]], tables: dict[str, DataFrame], explained: list[tuple[str, str]] | None = None, whole: dict[tuple[str, str], Callable] | None = None) -> DataFrame:
    """query_id, source (table.column), target (an output or ROWS), verdict: 'explained', 'unexplained' (lineage lacks it) or 'not seen' (lineage says it, no run shows it).

    ``explained`` are the statements as the analysis gets them, where they differ from those that run; ``whole`` as of influences()."""
    a = Analysis(spark, explained or statements, catalog.columns_of(spark, tables))
    seen = small_table(a.spark, influences(spark, statements, tables, whole), "query_id string, source string, target string")
    short = F.regexp_replace("column_id", "^column:default[.]", "")
    out = a._outputs.select("query_id", "output_id", F.col("output_name").alias("target"))
    # through expressions, to the outputs
    e = a.edges.where("edge_type <> 'write'").select("query_id", "source", F.col("target").alias("via"))
    through = e.where("via like 'expression:%'").select("query_id", "source", F.col("via").alias("mid")).join(e.select("query_id", F.col("source").alias("mid"), "via"), ["query_id", "mid"]).select("query_id", "source", "via")
    led = e.unionByName(through).join(out, (F.col("via") == F.col("output_id")) & (e["query_id"] == out["query_id"])).select(e["query_id"], F.regexp_replace("source", "^column:default[.]", "").alias("source"), "target")
    led = led.where("source not like '%:%'").distinct()
    rows = a.row_sources.select("query_id", short.alias("source"))
    edge = led.withColumn("edge", F.lit(True))
    both = seen.withColumn("seen", F.lit(True)).join(edge, ["query_id", "source", "target"], "full")
    both = both.join(rows.withColumn("rows", F.lit(True)), ["query_id", "source"], "left")
    verdict = F.when(F.col("seen") & (F.col("rows") | (F.col("edge") & (F.col("target") != ROWS))), "explained").when(F.col("seen"), "unexplained").when(F.col("rows").isNull(), "not seen")
    return both.withColumn("verdict", verdict).where("verdict is not null").select("query_id", "source", "target", "verdict")


def oracle(statements: list[tuple[str, str, list[str]]], tables: dict[str, str]) -> str:
    """SQL for prove() where lineage explains all that is seen: (query_id, statement, outputs), and the columns of each table as 'name, ...'."""
    names = {t: c.split(", ") for t, c in tables.items()}
    parts = []
    for q, sql, outputs in statements:
        o = [f"o{i}" for i in range(len(outputs))]
        float_ = lambda x: f"typeof({x}) IN ('DOUBLE', 'FLOAT')"
        cells = ", ".join(f"count({x}) AS c_{x}, sum(CASE WHEN {float_(x)} THEN 0 ELSE hash({x}) END) AS h_{x}, sum(CASE WHEN {float_(x)} THEN TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) END) AS s_{x}, sum(CASE WHEN {float_(x)} THEN TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE) ^ 2 END) AS q_{x}" for x in o)
        run = f"SELECT count(*) AS n, {cells} FROM ({sql}) AS z({', '.join(o)})"
        far = lambda x: f"(b.{x} IS NULL) <> (v.{x} IS NULL) OR abs(b.{x} - v.{x}) > {TOLERANCE} * greatest(abs(b.{x}), abs(v.{x}))"
        changed = ", ".join(f"CASE WHEN b.c_{x} <> v.c_{x} OR b.h_{x} IS DISTINCT FROM v.h_{x} OR {far(f's_{x}')} OR {far(f'q_{x}')} THEN '{name}' END" for x, name in zip(o, outputs, strict=True))
        for t, c in read(sql, names):
            erased = f"WITH {t} AS (SELECT * REPLACE (CASE WHEN false THEN {c} END AS {c}) FROM main.{t}) {run}"
            parts.append(f"SELECT '{q}' AS query_id, '{t}.{c}' AS source, unnest(CASE WHEN b.n <> v.n THEN ['{ROWS}'] ELSE [{changed}] END) AS target FROM ({run}) b, ({erased}) v")
    return "SELECT DISTINCT query_id, source, target, 'explained' AS verdict FROM (" + " UNION ALL ".join(parts) + ") WHERE target IS NOT NULL"


def isolated(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A session with the caller's settings and with tables as its views; the caller's views stay as they are."""
    own = spark.newSession()
    copy_settings(spark, own)
    for t, df in tables.items():
        own.read.schema(df.schema).parquet(*df.inputFiles()).createOrReplaceTempView(t)
    return own


def written(spark: SparkSession, statements: list[tuple[str, str, dict[str, str]]], tables: dict[str, DataFrame]) -> DataFrame:
    """Runs statements that write - (query_id, SQL with {name} for each target, columns of each target that is there before) - and reads back what
    stands in each column that lineage pairs with a value: query_id, target (table.column), sources (columns, sorted), n_values, width (of all values as text)."""
    mark = f"_{uuid.uuid4().hex[:12]}"
    own, rows, texts, declared = isolated(spark, tables), [], [], {}
    pattern = re.compile(r"\{(\w+)\}")
    for q, sql, targets in statements:
        names = {x: x + mark for x in pattern.findall(sql)}
        declared |= {names[t]: ddl for t, ddl in targets.items()}
        texts.append((q, pattern.sub(lambda m, names=names: names[m[1]], sql), names))
    partitioned = lambda ddl: "" if "|" not in ddl else f" PARTITIONED BY ({ddl.split('|')[1]})"
    try:
        for name, ddl in declared.items():
            own.sql(f"CREATE TABLE {name} ({ddl.split('|')[0]}) USING parquet{partitioned(ddl)}")
        known = catalog.columns_of(spark, tables).unionByName(catalog.columns_from(spark, {n: ddl.split("|")[0] for n, ddl in declared.items()}))
        for _, sql, _ in texts:
            own.sql(sql)
        a = Analysis(spark, [(q, sql) for q, sql, _ in texts], known)
        w = a.writes.where("target is not null").join(a.write_sources, ["query_id", "owner", "ordinal"], "left")
        short = F.regexp_replace(F.col("column_id"), "^column:default[.]", "")
        for r in w.groupBy("query_id", "table_id", "target_name").agg(F.array_join(F.array_sort(F.collect_set(short)), ", ").alias("sources")).collect():
            table = r.table_id.rpartition(".")[2]
            found = own.table(table).agg(F.count(r.target_name).alias("n"), F.sum(F.length(F.col(r.target_name).cast("string"))).alias("w")).first()
            rows.append((r.query_id, f"{table.removesuffix(mark)}.{r.target_name}", r.sources, found.n, found.w))
    finally:
        for _, _, names in texts:
            for name in names.values():
                own.sql(f"DROP TABLE IF EXISTS {name}")
    return small_table(spark, rows, "query_id string, target string, sources string, n_values bigint, width bigint")


def merge_counts(spark: SparkSession, statements: list[tuple[str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """What each action of MERGE statements would do to the given tables: query_id, action, target (table.column; the table for rows that are deleted), sources, n_rows."""
    own = isolated(spark, tables)
    a = Analysis(spark, statements, catalog.columns_of(spark, tables))
    short = F.regexp_replace(F.col("column_id"), "^column:default[.]", "")
    pairs = a.writes.join(a.write_sources, ["query_id", "owner", "ordinal"], "left").groupBy("query_id", "write_ord", "own", "target_name").agg(F.array_join(F.array_sort(F.collect_set(short)), ", ").alias("sources")).collect()
    rows = []
    for q, sql in statements:
        p = parse(spark, [(q, sql)])
        into, using = [r for r in p["relations"] if r[1] == ROOT][:2]
        condition = next(c for c in p["clauses"] if c[3] == "join_on")
        on, source = condition[5], re.search(r"(?is)\bUSING\b(.*?)\bON\s*$", sql[: condition[6]])[1]
        text = lambda r: f"{into[7]} AS {into[4]}" if r is into else source  # noqa: B023, E731
        missed = lambda x, y: f"SELECT COUNT(*) AS n FROM {text(x)} LEFT ANTI JOIN {text(y)} ON {on}"  # noqa: B023, E731
        taken = {"matched": [], "missing": []}
        for w in sorted((w for w in p["writes"]), key=lambda w: w[1]):
            seen = {r[4] for r in p["relations"] if r[1] == w[3]} if w[3] != ROOT else {into[4], using[4]}
            number = w[1]
            when = next((c[5] for c in p["clauses"] if c[3] == "merge_when" and c[4] == number), None)
            if seen == {into[4], using[4]} or w[2] == "merge_update" and w[8] is None:  # WHEN MATCHED
                # the first action whose condition holds is a row's
                before = " ".join(f"AND NOT coalesce({x}, FALSE)" for x in taken["matched"] if x) + (" AND FALSE" if None in taken["matched"] else "")
                query = f"SELECT COUNT(*) AS n FROM {text(into)} JOIN {text(using)} ON {on} WHERE {when or 'TRUE'} {before}"
                taken["matched"].append(when)
            elif w[2] == "merge_insert":
                query = missed(using, into) + (f" WHERE {when}" if when else "")
            else:
                query = missed(into, using) + (f" WHERE {when}" if when else "")
            n = own.sql(query).first().n
            rows += [(q, w[2], f"{x.own}.{x.target_name}" if x.target_name else x.own, x.sources, n) for x in pairs if x.query_id == q and x.write_ord == number]
    return small_table(spark, rows, "query_id string, action string, target string, sources string, n_rows bigint")


__all__ = ["ROOT", "ROWS", "influences", "merge_counts", "oracle", "prove", "read", "written"]
