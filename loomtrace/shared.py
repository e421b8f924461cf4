"""Cutting a DataFrame's lineage in the folder that the driver and the executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an own one where that is unset, as on one machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that the driver and the executors share, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A DataFrame of rows that are on the driver; its size is known to the optimizer."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(ddl)
    types = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=types), schema)


#: Rows that a table on the driver may have.
FEW = 20_000


def brought(df: DataFrame) -> DataFrame:
    """df, run and held on the driver if it has FEW rows at most; else written to the shared folder."""
    got = df.limit(FEW + 1).toArrow()
    return df.sparkSession.createDataFrame(got, df.schema) if got.num_rows <= FEW else cut(df)


def copy_settings(spark: SparkSession, to: SparkSession) -> None:
    """All SQL settings of a session (case sensitivity, ANSI mode, time zone, ...) in another one of the same application."""
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and to.conf.isModifiable(k) and to.conf.get(k, None) != v:
            to.conf.set(k, v)


#: Settings of a session for tables of few rows.
LIGHT = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "1", "spark.sql.leafNodeDefaultParallelism": "1"}
_quick: dict = {}


def quick(spark: SparkSession) -> SparkSession:
    """A session of the same application for tables of few rows: no code generation, one partition, no plans changed at run time; all other settings are the caller's."""
    settings = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.") and k not in LIGHT}
    key = (spark.sparkContext.applicationId, tuple(sorted(settings.items())))
    if key not in _quick:
        made = spark.newSession()
        copy_settings(spark, made)
        for k, v in LIGHT.items():
            made.conf.set(k, v)
        _quick.clear()
        _quick[key] = made
    return _quick[key]
