"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


#: Parts in which a node's edges are joined.
SALTS = 16


def salted(edges: DataFrame, of: DataFrame) -> DataFrame:
    """edges (u, v) left joined with ``of`` (u, m), a node's edges dealt to SALTS tasks."""
    left = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return left.join(of.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "s"], "left")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Each step is a minimum per node (combined before the shuffle) and a join with those nodes only whose edges it changes, in
    SALTS parts a node; so a hub's neighbours are neither gathered in one row nor joined in one task.  Rounds are cut from
    their lineage in the shared folder.  Edges from a node to itself and nulls are ignored.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # neighbours above a node go to its smallest neighbour: a change where it has one below
        span = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        up = both.where("v > u")
        large = (
            salted(up, span.where("m < u and x > u").select("u", "m")).select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
            .distinct()
        )
        # neighbours below a node, and itself, go to the smallest of them: a change where it has several
        span = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        joined = salted(large, span.where("m < x").select("u", "m")).where("v <> coalesce(m, v)")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(span.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")))
        .distinct()
    )
