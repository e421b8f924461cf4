"""What the semantics report says of grains and joins, measured on the tables.

A join key's figures are those of its columns in their table: rows, different keys, most rows of one key.  They are counted once
for each set of columns, whatever number of statements join on it.  Both sides repeated: each row may meet several on either
side, so sums are wrong (risk high, level error); one side repeated: rows of the other side are multiplied (medium, warning); neither: low.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, small_table
from ..sources import catalog
from .analysis import KEY, ROOT, Analysis
from .proof import isolated


def join_sides(a: Analysis) -> list[tuple]:
    """(query_id, owner, left table, left columns, right table, right columns) of the joins by equality whose sides are columns of the catalog."""
    sides = a.resolved.where("clause in ('key_l', 'key_r') and status = 'resolved' and kind = 'table'").select(*KEY, "ordinal", "clause", F.regexp_replace("column_id", "^column:default[.]", "").alias("column"), "relation_alias")
    rows = sorted(sides.collect(), key=lambda r: (r.query_id, r.owner, r.segment_index, r.ordinal))
    keys: dict = {}
    for r in rows:
        keys.setdefault((r.query_id, r.owner, r.segment_index, r.ordinal), {})[r.clause[-1]] = (r.column, r.relation_alias)
    groups: dict = {}
    for (q, owner, segment, _), k in keys.items():
        if len(k) == 2:
            groups.setdefault((q, owner, segment, k["l"][1], k["r"][1]), []).append((k["l"][0], k["r"][0]))
    out = []
    for (q, owner, *_), pairs in groups.items():
        left, right = ([p[i] for p in pairs] for i in (0, 1))
        out.append((q, owner, left[0].rpartition(".")[0], tuple(c.rpartition(".")[2] for c in left), right[0].rpartition(".")[0], tuple(c.rpartition(".")[2] for c in right)))
    return out


def measured_joins(spark: SparkSession, statements: list[tuple[str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """query_id, left_key, right_key, left_rows, left_keys, right_rows, right_keys, joined_rows, risk (low, medium, high), level (info, warning, error): of each join of tables by equality."""
    a = Analysis(spark, statements, catalog.columns_of(spark, tables))
    joins = join_sides(a)
    counted, figures = {}, {}

    def counts(table: str, columns: tuple) -> DataFrame:
        if (table, columns) not in counted:
            rows = tables[table].where(" and ".join(f"{c} is not null" for c in columns))
            counted[table, columns] = cut(rows.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n")))
        return counted[table, columns]

    def figure(table: str, columns: tuple):
        if (table, columns) not in figures:
            figures[table, columns] = counts(table, columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        return figures[table, columns]

    out, met = [], {}
    for q, _, lt, lc, rt, rc in sorted(joins):
        left, right = figure(lt, lc), figure(rt, rc)
        if (lt, lc, rt, rc) not in met:
            names = [f"k{i}" for i in range(len(lc))]
            met[lt, lc, rt, rc] = counts(lt, lc).join(counts(rt, rc).withColumnRenamed("n", "m"), names).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        repeated = (left.most > 1) + (right.most > 1)
        name = lambda t, cs: ", ".join(f"{t}.{c}" for c in cs)
        out.append((q, name(lt, lc), name(rt, rc), left.rows, left["keys"], right.rows, right["keys"], met[lt, lc, rt, rc], ("low", "medium", "high")[repeated], ("info", "warning", "error")[repeated]))
    return small_table(spark, out, "query_id string, left_key string, right_key string, left_rows bigint, left_keys bigint, right_rows bigint, right_keys bigint, joined_rows bigint, risk string, level string")


def measured_grains(spark: SparkSession, statements: list[tuple[str, str]], tables: dict[str, DataFrame]) -> DataFrame:
    """query_id, grain_type, n_rows, n_groups (different values of the grain's outputs; of a detail grain: of all outputs), is_unique: whether a statement's rows are what its grain says."""
    a = Analysis(spark, statements, catalog.columns_of(spark, tables))
    own = isolated(spark, tables)
    outputs: dict = {}
    for r in a._outputs.select("query_id", "ordinal", "output_name").collect():
        outputs.setdefault(r.query_id, {})[r.ordinal] = r.output_name
    items: dict = {}
    for r in a.items.where((F.col("owner") == ROOT) & (F.col("segment_index") == 0)).select("query_id", "ordinal", "expression_sql", "output_name").collect():
        items.setdefault(r.query_id, []).append(r)
    out = []
    for r in a.grain.collect():
        names = outputs[r.query_id]
        wanted = [c.strip().lower() for c in (r.columns or "").split(",") if c.strip()]
        match = lambda i, w: w in (str(i.ordinal), i.output_name.lower(), i.expression_sql.lower(), i.expression_sql.lower().rpartition(" as ")[0])
        places = sorted({i.ordinal for i in items[r.query_id] for w in wanted if match(i, w)}) or sorted(names)
        df = own.sql(dict(statements)[r.query_id]).toDF(*[f"o{k}" for k in sorted(names)])
        n = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*[f"o{k}" for k in places])).alias("g")).first()
        out.append((r.query_id, r.grain_type, n.n, n.g, n.n == n.g))
    spark.createDataFrame([], "none int")
    return small_table(spark, out, "query_id string, grain_type string, n_rows bigint, n_groups bigint, is_unique boolean")
