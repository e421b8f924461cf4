"""The catalog of tables and columns: registered from DataFrames, or imported from the JSON payload format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..shared import small_table

#: The strict import format (fixed names).
PAYLOAD = "schema_version string, metadata_version string, case_sensitive boolean, default_catalog string, default_schema string, source_name string, tables array<struct<catalog:string, schema:string, name:string, comment:string, table_type:string, columns:array<struct<name:string, data_type:string, comment:string, ordinal:int, is_partition:boolean, nullable:boolean>>>>"
COLUMNS = "metadata_version string, catalog string, schema_name string, table_name string, column_name string, data_type string, comment string, ordinal int, is_partition boolean"
#: Types that hold other types, and types with a size, with how many numbers that takes.
NESTED, SIZED = ("array", "map", "struct"), {"decimal": 2, "numeric": 2, "varchar": 1, "char": 1}


def is_complex(kind: Column) -> Column:
    """Whether a type holds other types or is written with all its sizes."""
    name = F.lower(F.regexp_extract(kind, r"^\s*(\w+)", 1))
    inside = F.regexp_extract(kind, r"^\s*\w+\(([^()]*)\)", 1)
    sizes = F.transform(F.split(inside, ","), F.trim)
    sized = F.lit(False)
    for k, n in SIZED.items():
        sized = sized | ((name == k) & (F.size(sizes) == n))
    return (name.isin(*NESTED) & kind.contains("<")) | (sized & F.forall(sizes, lambda x: x.rlike("^[0-9]+$")))


def columns_of(spark: SparkSession, tables: dict[str, DataFrame], version: str = "v1") -> DataFrame:
    """Catalog rows of DataFrames' own schemas."""
    rows = [(version, "default", "default", t, f.name, f.dataType.simpleString(), None, i, False) for t, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return small_table(spark, rows, COLUMNS)


def columns_from(spark: SparkSession, tables: dict[str, str], version: str = "v1", partitions: tuple[str, ...] = ()) -> DataFrame:
    """Catalog rows of tables given as {'[schema.]table': 'col type, col type'}; ``partitions`` names partition columns."""
    rows = []
    for t, ddl in tables.items():
        schema, name = t.split(".") if "." in t else ("default", t)
        for i, c in enumerate(ddl.split(", "), 1):
            column, kind = c.split(" ", 1)
            rows.append((version, "default", schema, name, column, kind, None, i, column in partitions))
    return small_table(spark, rows, COLUMNS)


def unknown_keys(got: T.DataType, want: T.DataType, at: str = "") -> list[str]:
    """Fields of a type that another one lacks, at any depth."""
    if isinstance(got, T.ArrayType) and isinstance(want, T.ArrayType):
        return unknown_keys(got.elementType, want.elementType, at + "[]")
    if not (isinstance(got, T.StructType) and isinstance(want, T.StructType)):
        return []
    out = [f"{at}.{f.name}".strip(".") for f in got if f.name not in want.names]
    return out + [x for f in got if f.name in want.names for x in unknown_keys(f.dataType, want[f.name].dataType, f"{at}.{f.name}")]


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """A payload file; a malformed one fails, and so does one with unknown keys at any depth."""
    reader = lambda: spark.read.option("multiLine", True).option("mode", "FAILFAST")
    got = reader().schema(PAYLOAD).json(path)
    if extra := unknown_keys(reader().json(path).schema, got.schema):
        raise ValueError(f"unknown keys: {sorted(extra)}")
    return got


def payload_columns(payload: DataFrame) -> DataFrame:
    """One row a column, with its places t_idx and c_idx; tables without columns keep one row with a null name."""
    t = payload.select(
        "metadata_version",
        F.coalesce("default_catalog", F.lit("default")).alias("dc"),
        F.coalesce("default_schema", F.lit("default")).alias("ds"),
        F.posexplode_outer("tables").alias("t_idx", "t"),
    )
    c = t.select(
        "metadata_version",
        "t_idx",
        F.coalesce("t.catalog", "dc").alias("catalog"),
        F.coalesce("t.schema", "ds").alias("schema_name"),
        F.col("t.name").alias("table_name"),
        F.posexplode_outer("t.columns").alias("c_idx", "c"),
    )
    return c.select(
        "metadata_version",
        "t_idx",
        "catalog",
        "schema_name",
        "table_name",
        "c_idx",
        F.col("c.name").alias("column_name"),
        F.coalesce("c.data_type", F.lit("unknown")).alias("data_type"),
        F.col("c.comment").alias("comment"),
        F.col("c.ordinal").alias("ordinal"),
        F.coalesce("c.is_partition", F.lit(False)).alias("is_partition"),
    )


def validate(payload: DataFrame) -> DataFrame:
    """t_idx, c_idx, code, level: what an import reports."""
    c = payload_columns(payload)
    blank = (
        c.where("table_name is null or trim(table_name) = ''")
        .select(
            "t_idx",
            F.lit(None).cast("int").alias("c_idx"),
            F.lit("METADATA_IMPORT_EMPTY_TABLE_NAME").alias("code"),
            F.lit("error").alias("level"),
        )
        .distinct()
    )
    empty = (
        c.where("column_name is null and c_idx is null")
        .select(
            "t_idx",
            F.lit(None).cast("int").alias("c_idx"),
            F.lit("METADATA_IMPORT_EMPTY_COLUMNS").alias("code"),
            F.lit("error").alias("level"),
        )
    )
    w = Window.partitionBy("t_idx", F.lower(F.trim("column_name"))).orderBy("c_idx")
    named = c.where("column_name is not null")
    twice = (
        named.withColumn("n", F.row_number().over(w))
        .where("n > 1")
        .select("t_idx", "c_idx", F.lit("METADATA_IMPORT_DUPLICATE_COLUMN").alias("code"), F.lit("error").alias("level"))
    )
    deep = (
        named.where(is_complex(F.col("data_type")))
        .select("t_idx", "c_idx", F.lit("METADATA_IMPORT_COMPLEX_TYPE").alias("code"), F.lit("info").alias("level"))
    )
    loose = (
        named.where("ordinal is null")
        .select("t_idx", "c_idx", F.lit("METADATA_IMPORT_MISSING_ORDINAL").alias("code"), F.lit("warning").alias("level"))
    )
    version = (
        payload.where("coalesce(schema_version, '1.0') <> '1.0'")
        .select(
            F.lit(None).cast("int").alias("t_idx"),
            F.lit(None).cast("int").alias("c_idx"),
            F.lit("METADATA_IMPORT_SCHEMA_UNSUPPORTED").alias("code"),
            F.lit("error").alias("level"),
        )
    )
    return version.unionByName(blank).unionByName(empty).unionByName(twice).unionByName(deep).unionByName(loose)


def diff(payload: DataFrame, current: DataFrame) -> DataFrame:
    """table_name, change, added_columns: by the set of column names, as types and comments don't count.  Tables are the same by catalog, schema and name in any case."""
    key = ["catalog", "schema_name", "t"]
    sets = lambda df: df.withColumn("t", ids.normal(F.col("table_name"))).groupBy(*key).agg(F.min("table_name").alias("table_name"), F.array_sort(F.collect_set(ids.normal(F.col("column_name")))).alias("names"))
    new = sets(payload_columns(payload).where("column_name is not null"))
    old = sets(current).select(*key, F.col("names").alias("old"))
    j = new.join(old, key, "left")
    change = F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("names"), "unchanged").otherwise("updated")
    return j.select(
        "table_name",
        change.alias("change"),
        F.size(F.array_except("names", F.coalesce("old", F.array().cast("array<string>")))).cast("bigint").alias("added_columns"),
    )


def preview(payload: DataFrame, current: DataFrame) -> DataFrame:
    """What a commit would do, in one row: metadata_version, status, tables, total_columns, added, updated, unchanged, errors,
    warnings, info.  Nothing is written; a payload of an unsupported schema version is one error and is not looked at further."""
    found = validate(payload)
    levels = found.agg(
        *[F.count_if(F.col("level") == x).alias(n) for x, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))],
        F.coalesce(F.bool_or(F.col("code") == "METADATA_IMPORT_SCHEMA_UNSUPPORTED"), F.lit(False)).alias("stop"),
    )
    changes = diff(payload, current).agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("added", "updated", "unchanged")])
    c = payload_columns(payload)
    counts = c.agg(F.count_distinct("t_idx").alias("tables"), F.count("column_name").alias("total_columns"))
    one = payload.select("metadata_version").crossJoin(counts).crossJoin(changes).crossJoin(levels)  # one row each
    stop = F.col("stop")
    zero = lambda n: F.when(stop, F.lit(0)).otherwise(F.col(n)).cast("bigint").alias(n)
    counted = ("total_columns", "added", "updated", "unchanged")
    return one.select(
        "metadata_version",
        F.lit("preview_ready").alias("status"),
        "tables",
        *[zero(n) for n in counted],
        F.when(stop, F.lit(1)).otherwise(F.col("errors")).cast("bigint").alias("errors"),
        zero("warnings"),
        zero("info"),
    )


def merged(payload: DataFrame, current: DataFrame) -> DataFrame:
    """The catalog after a commit: the payload's tables replace those of their names; of equal column names the last wins."""
    c = payload_columns(payload).where("column_name is not null and trim(table_name) <> ''")
    last = (
        c.withColumn(
            "n",
            F.row_number().over(Window.partitionBy(
                "catalog",
                "schema_name",
                ids.normal(F.col("table_name")),
                ids.normal(F.col("column_name")),
            ).orderBy(F.desc("t_idx"), F.desc("c_idx"))),
        )
        .where("n = 1")
    )
    new = last.select(
        "metadata_version",
        "catalog",
        "schema_name",
        "table_name",
        "column_name",
        "data_type",
        "comment",
        F.coalesce("ordinal", F.col("c_idx") + 1).alias("ordinal"),
        "is_partition",
    )
    tables = new.select("catalog", "schema_name", ids.normal(F.col("table_name")).alias("t")).distinct()
    old = (
        current.withColumn("t", ids.normal(F.col("table_name")))
        .join(tables, ["catalog", "schema_name", "t"], "left_anti")
        .select(*new.columns)
    )
    return old.unionByName(new)


def commit(payload: DataFrame, current: DataFrame, versions: DataFrame, job_id: str) -> dict[str, DataFrame]:
    """What a commit writes: columns (the new catalog), versions (with the payload's, counted on), jobs (one row) and
    errors.  Only an unsupported schema version stops it; the columns then stay as they are and the job is failed."""
    found = validate(payload)
    errors = (
        found.where("level = 'error'")
        .select(
            F.lit(job_id).alias("job_id"),
            F.col("t_idx").alias("table_index"),
            F.col("c_idx").alias("column_index"),
            F.col("code").alias("error_code"),
        )
    )
    stopped = not found.where("code = 'METADATA_IMPORT_SCHEMA_UNSUPPORTED'").isEmpty()
    columns = current if stopped else merged(payload, current)
    c = payload_columns(payload).where("column_name is not null")
    counts = c.agg(F.count_distinct("t_idx").alias("total_tables"), F.count(F.lit(1)).alias("total_columns"))
    bad = errors.agg(F.count(F.lit(1)).alias("error_count"))
    version = payload.select("metadata_version")
    jobs = version.crossJoin(counts).crossJoin(bad).select(F.lit(job_id).alias("job_id"), "metadata_version", F.lit("failed" if stopped else "committed").alias("status"), "total_tables", "total_columns", "error_count")  # one row each
    last = versions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = (
        version.join(versions, version["metadata_version"] == versions["version"], "left_anti")
        .crossJoin(last)
        .select(F.col("metadata_version").alias("version"), (F.col("last") + 1).alias("seq"))
    )
    return {"columns": columns, "versions": versions if stopped else versions.select("version", "seq").unionByName(new), "jobs": jobs, "errors": errors}


def latest(versions: DataFrame) -> DataFrame:
    """The version of the largest seq."""
    return versions.agg(F.max_by("version", "seq").alias("version"))


def of_version(columns: DataFrame, version: str | None, names: dict[str, str | None]) -> DataFrame:
    """Catalog rows of a version and of the given catalog and schema, where these are given."""
    for column, value in {"metadata_version": version, **names}.items():
        if value is not None:
            columns = columns.where(F.col(column) == value)
    return columns


def search_tables(columns: DataFrame, keyword: str = "", limit: int = 20, version: str | None = None, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    c = of_version(columns, version, {"catalog": catalog, "schema_name": schema})
    return (
        c.where(F.lower("table_name").contains(keyword.lower()))
        .select("catalog", "schema_name", "table_name")
        .distinct()
        .orderBy("table_name", "schema_name", "catalog")
        .limit(limit)
    )


def table_named(columns: DataFrame, table: str, version: str | None = None, catalog: str = "default", schema: str = "default") -> DataFrame:
    """The table of a name in any case: catalog, schema_name, table_name; no row if there is none."""
    c = of_version(columns, version, {"catalog": catalog, "schema_name": schema})
    return c.where(ids.normal(F.col("table_name")) == ids.normal(F.lit(table))).select("catalog", "schema_name", "table_name").distinct()


def search_columns(columns: DataFrame, table: str, keyword: str | Column = "", limit: int = 50, version: str | None = None) -> DataFrame:
    word = F.lower(F.lit(keyword) if isinstance(keyword, str) else keyword)
    c = of_version(columns, version, {}).where((F.lower("table_name") == table.lower()) & F.lower("column_name").contains(word))
    return c.select("table_name", "column_name", "data_type", "ordinal").orderBy("ordinal").limit(limit)


def context(columns: DataFrame, version: str | None = None) -> DataFrame:
    """catalog, schema_name, table_name, columns (structs in their order): all tables of a version."""
    c = of_version(columns, version, {})
    return (
        c.groupBy("catalog", "schema_name", "table_name")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "is_partition"))).alias("columns"))
    )


def exported(columns: DataFrame, version: str, schema: str | None = None, top: int | None = None, source: str = "catalog") -> DataFrame:
    """A payload of a version's tables (of one schema; the first ``top`` by name)."""
    c = of_version(columns, version, {"schema_name": schema})
    tables = (
        c.groupBy("catalog", "schema_name", "table_name")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "comment", "is_partition"))).alias("cols"))
    )
    if top is not None:
        tables = tables.orderBy("table_name", "schema_name", "catalog").limit(top)
    each = F.transform(
        "cols",
        lambda x: F.struct(
            x["column_name"].alias("name"),
            x["data_type"].alias("data_type"),
            x["comment"].alias("comment"),
            x["ordinal"].alias("ordinal"),
            x["is_partition"].alias("is_partition"),
            F.lit(True).alias("nullable"),
        ),
    )
    none = F.lit(None).cast("string")
    one = F.struct(
        "catalog",
        F.col("schema_name").alias("schema"),
        F.col("table_name").alias("name"),
        none.alias("comment"),
        none.alias("table_type"),
        each.alias("columns"),
    )
    made = tables.agg(F.array_sort(F.collect_list(F.struct(
        F.col("table_name").alias("o"),
        F.col("schema_name").alias("p"),
        F.col("catalog").alias("q"),
        one.alias("t"),
    ))).alias("ts"))
    heads = [F.lit("1.0").alias("schema_version"), F.lit(version).alias("metadata_version"), F.lit(False).alias("case_sensitive"), F.lit("default").alias("default_catalog"), F.lit("default").alias("default_schema"), F.lit(source).alias("source_name")]
    return made.select(*heads, F.transform("ts", lambda x: x["t"]).alias("tables"))
