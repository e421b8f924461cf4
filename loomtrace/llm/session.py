"""What the operators take from the session: shared folder, partition counts, ordered buckets."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.  Where that is unset, an own one on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fanout(df: DataFrame) -> int:
    """Partitions for a shuffle of df's texts: at least as many as it is read in, so that a partition doesn't grow with the input."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(conf, df.rdd.getNumPartitions())


#: A key that has at least this part of all rows is joined by broadcast.
HEAVY = 1000


def keyed(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows inner joined with a table that has each key once and, as ``weight``, how many rows have it.

    Keys that hold a thousandth of the rows or more - a thousand at most, whatever the input's size - are broadcast, so that no task has all rows of
    one; the others are shuffled, each no more than a thousandth of the rows."""
    table = cut(table)
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * F.lit(HEAVY) >= F.lit(max(total, HEAVY))
    heavy, light = table.where(hot), table.where(~hot)
    few = F.broadcast(heavy)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


#: A bucket may hold so many times its share of the rows.
UNEVEN = 4


class OrderedBuckets:
    """Buckets of about equal size that ascend with some columns.  Spark's range partitioner samples the cuts, one a
    partition; they go into plans as one constant of some 16 bytes a partition, not as expressions.

    Cuts are looked for by the first column alone, so that what the others are made of (texts) isn't read for it; only where one
    of its values fills a bucket several times over are they looked for by all columns."""

    def __init__(self, df: DataFrame, columns: list[Column], parts: int):

        def found(use: list[Column]) -> tuple[list[tuple], bool]:
            order = F.struct(*[c.cast("bigint").alias(f"o{i}") for i, c in enumerate(use)])
            dealt = df.select(order.alias("o")).repartitionByRange(max(1, parts), "o").select(F.spark_partition_id().alias("p"), "o")
            rows = dealt.groupBy("p").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n")).collect()
            total = sum(r.n for r in rows)
            even = len(rows) >= parts // 2 and max((r.n for r in rows), default=0) * max(1, parts) <= UNEVEN * total or total <= len(rows)
            return sorted(tuple(r.o) for r in rows)[1:], even

        cuts, even = found(columns[:1])
        if len(columns) > 1 and not even:
            cuts, _ = found(columns)
        least = (-(1 << 63),) * (len(columns) - 1)
        cuts = [c if len(c) == len(columns) else c + least for c in cuts]
        self.n = len(cuts) + 1
        self.width = max(1, int(len(cuts) ** 0.5))
        groups = [cuts[i : i + self.width] for i in range(0, len(cuts), self.width)]
        item = "struct<" + ",".join(f"o{i}:bigint" for i in range(len(columns))) + ">"
        named = [[{f"o{i}": x for i, x in enumerate(c)} for c in g] for g in groups]
        # constants by the optimizer's folding
        self.heads = F.from_json(F.lit(json.dumps([g[0] for g in named])), f"array<{item}>")
        self.groups = F.from_json(F.lit(json.dumps(named)), f"array<array<{item}>>")

    def of(self, *columns: Column) -> Column:
        """The number of cuts that are not above a row, found in two steps of about sqrt(n) comparisons."""
        if self.n == 1:
            return F.lit(0)
        own = F.struct(*[c.cast("bigint").alias(f"o{i}") for i, c in enumerate(columns)])
        group = F.size(F.filter(self.heads, lambda x: x <= own))
        inner = F.size(F.filter(F.element_at(self.groups, F.greatest(group, F.lit(1))), lambda x: x <= own))
        return F.when(group == 0, F.lit(0)).otherwise((group - 1) * F.lit(self.width) + inner).cast("int")


def local_path(folder: str) -> str | None:
    """The plain path of a file: folder; None for other stores."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if "://" not in folder else None


def put_file(folder: str, name: str, payload: list) -> None:
    """Writes a file of the shared folder so that it is there in full or not at all; a repeated task writes the same file again."""
    if path := local_path(folder):
        os.makedirs(path, exist_ok=True)
        temp = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            for x in payload:
                f.write(x)
        os.replace(temp, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        for x in payload:
            f.write(x)
    store.move(temp, f"{path}/{name}")


def get_file(folder: str, name: str) -> bytes:
    """The content of a file of the shared folder."""
    if path := local_path(folder):
        with open(f"{path}/{name}", "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return f.read()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def release() -> None:
    """Gives memory that a task has freed back to the system: workers live on, and their later tasks may need less."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow on executors that have this package."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)
