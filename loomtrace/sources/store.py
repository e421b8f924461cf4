"""The catalog's store: five Parquet tables under one folder, published together.

A commit writes new files and then one small manifest that names the files of all tables; readers take the newest manifest,
so they see all of a commit or nothing of it.  Files of earlier manifests stay for readers that still use them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from . import catalog

TABLES = {
    "versions": "version string, seq bigint, source_name string, table_count bigint, created_at timestamp",
    "tables": "metadata_version string, catalog string, schema_name string, table_name string, normalized_name string, created_at timestamp, updated_at timestamp",
    "columns": catalog.COLUMNS,
    "jobs": "job_id string, metadata_version string, status string, total_tables bigint, total_columns bigint, skipped_tables bigint, error_count bigint, created_at timestamp",
    "errors": "job_id string, table_index int, column_index int, error_code string",
}


class Store:
    """Opening a folder that has no store yet makes an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._of = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._of(f"{self.path}/manifests"))

    # --- manifests ---

    def _newest(self) -> tuple[int, dict[str, str]]:
        """Number and content of the newest manifest; 0 and nothing in an empty store."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._of(f"{self.path}/manifests"))]
        names = sorted(n for n in names if n.endswith(".json"))
        if not names:
            return 0, {}
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect())
        return int(names[-1].split(".")[0]), json.loads(text)

    def read(self, name: str) -> DataFrame:
        """A table as of the newest manifest."""
        folder = self._newest()[1].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(folder) if folder else self.spark.createDataFrame([], TABLES[name])

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """Writes new contents of some tables, then names them all at once.  An error before that leaves the store as it was; of two commits at a time one fails."""
        number, now = self._newest()
        for name, df in tables.items():
            folder = f"{self.path}/{name}/{number + 1:09d}-{uuid.uuid4().hex}"
            df.select([F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], TABLES[name]).schema]).write.parquet(folder)
            now = {**now, name: folder}
        temp = self._of(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp")
        out = self._files.create(temp, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        final = self._of(f"{self.path}/manifests/{number + 1:09d}.json")
        if self._files.exists(final) or not self._files.rename(temp, final):
            raise RuntimeError("another commit was published meanwhile")

    # --- versions ---

    def versions(self) -> DataFrame:
        """All versions, newest first."""
        return self.read("versions").orderBy(F.desc("seq"))

    def effective_version(self, version: str | None = "latest") -> str | None:
        """A version's name: the newest one for 'latest' or none given; None if the store doesn't have it."""
        v = self.read("versions")
        row = (v.agg(F.max_by("version", "seq").alias("version")) if version in (None, "latest") else v.where(F.col("version") == version).select("version")).first()
        return row.version if row else None

    # --- lookups ---

    def _columns(self, version: str | None) -> DataFrame:
        return self.read("columns").where(F.col("metadata_version") == F.lit(self.effective_version(version)))

    def tables(self, version: str | None = "latest", catalog_name: str | None = None, schema: str | None = None, keyword: str = "", limit: int = 20) -> DataFrame:
        return catalog.search_tables(self._columns(version), keyword, limit, None, catalog_name, schema)

    def table(self, name: str, version: str | None = "latest", catalog_name: str = "default", schema: str = "default") -> DataFrame:
        return catalog.table_named(self._columns(version), name, None, catalog_name, schema)

    def columns(self, table: str, version: str | None = "latest", keyword: str = "", limit: int = 50) -> DataFrame:
        return catalog.search_columns(self._columns(version), table, keyword, limit)

    def context(self, version: str | None = "latest") -> DataFrame:
        return catalog.context(self._columns(version))

    # --- imports ---

    def preview(self, payload: DataFrame) -> DataFrame:
        return catalog.preview(payload, self._columns(payload.first().metadata_version))

    def commit(self, payload: DataFrame, job_id: str | None = None) -> str:
        """Imports a payload into its version; returns the job's id.  Tables without a name or columns are left out and
        counted as skipped; an unsupported schema version makes a failed job and changes nothing else."""
        job_id = job_id or f"job-{uuid.uuid4().hex[:12]}"
        head = payload.first()
        version, columns = head.metadata_version, self.read("columns")
        same = columns.where(F.col("metadata_version") == version)
        made = catalog.commit(payload, same, self.read("versions").select("version", "seq"), job_id)
        c = catalog.payload_columns(payload)
        skipped = (
            c.where("c_idx is null or table_name is null or trim(table_name) = ''")
            .agg(F.count_distinct("t_idx").alias("skipped_tables"))
        )
        now = F.current_timestamp()
        jobs = made["jobs"].crossJoin(skipped).withColumn("created_at", now)  # one row each
        new = {"jobs": self.read("jobs").unionByName(jobs), "errors": self.read("errors").unionByName(made["errors"])}
        if made["jobs"].first().status == "committed":
            mine = made["columns"]
            new["columns"] = columns.where(F.col("metadata_version") != version).unionByName(mine)
            key = ["metadata_version", "catalog", "schema_name", "normalized_name"]
            named = (
                mine.withColumn("normalized_name", ids.normal(F.col("table_name")))
                .groupBy(*key)
                .agg(F.min("table_name").alias("table_name"))
            )
            touched = (
                c.select("metadata_version", "catalog", "schema_name", ids.normal(F.col("table_name")).alias("normalized_name"))
                .distinct()
                .withColumn("touched", F.lit(True))
            )
            old = self.read("tables").select(*key, "created_at", "updated_at")
            tables = named.join(old, key, "left").join(touched, key, "left")
            tables = tables.select(
                *key,
                "table_name",
                F.coalesce("created_at", now).alias("created_at"),
                F.when(F.col("touched") | F.col("updated_at").isNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
            )
            new["tables"] = self.read("tables").where(F.col("metadata_version") != version).unionByName(tables)
            count = named.agg(F.count(F.lit(1)).alias("n"))
            was = (
                self.read("versions")
                .select("version", F.col("source_name").alias("s"), F.col("table_count").alias("n_old"), F.col("created_at").alias("at"))
            )
            own = F.col("version") == version
            v = made["versions"].join(was, "version", "left").crossJoin(count)  # one row
            new["versions"] = v.select(
                "version",
                "seq",
                F.when(own & F.col("s").isNull(), F.lit(head.source_name)).otherwise(F.col("s")).alias("source_name"),
                F.when(own, F.col("n")).otherwise(F.col("n_old")).alias("table_count"),
                F.coalesce("at", now).alias("created_at"),
            )
        self.publish(new)
        return job_id

    def load(self, path: str) -> str:
        """Imports a payload file: read strictly, checked, committed."""
        return self.commit(catalog.read_payload(self.spark, path))

    def export(self, path: str, version: str | None = "latest", schema: str | None = None, top: int | None = None) -> None:
        """Writes a version as a payload in JSON."""
        name = self.effective_version(version)
        catalog.exported(self.read("columns"), name, schema, top).write.json(path)
