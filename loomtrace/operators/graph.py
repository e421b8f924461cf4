"""Questions about the lineage graph: closures, layers, views, neighbourhoods, layout."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import brought


def closure(edges: DataFrame, start: str, upstream: bool = True, most: int | None = None) -> DataFrame:
    """query_id, id, distance: what a node is made from (or goes into), each once with its least number of steps.  Each
    round joins only the newly reached nodes, and leaves out those reached before, so that cycles end.  More than ``most`` steps, if given, are an error."""
    here, there = ("target", "source") if upstream else ("source", "target")
    e = edges.select("query_id", F.col(here).alias("h"), F.col(there).alias("t")).distinct()
    e = brought(e)
    front = brought(e.where(F.col("h") == start).select("query_id", F.col("t").alias("id"), F.lit(1).alias("distance")).distinct())
    seen = front
    for step in count(2):
        reached = (
            front.select("query_id", F.col("id").alias("h"))
            .join(e, ["query_id", "h"])
            .select("query_id", F.col("t").alias("id"), F.lit(step).alias("distance"))
            .distinct()
        )
        front = brought(reached.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti"))
        if front.isEmpty():
            break
        if most is not None and step > most:
            raise RuntimeError(f"the closure of {start} has more than {most} steps")
        seen = brought(seen.unionByName(front))
    return seen.where(F.col("id") != start)


def levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """query_id, id, level of tables and CTEs: tables 0, a CTE one more than its highest source.  Levels are below the number of nodes; a cycle, or more than ``most`` rounds, is an error."""
    n = nodes.where("node_type in ('table', 'cte')").select("query_id", "id", "node_type").distinct()
    e = edges.where("source like 'table:%' and target like 'table:%'").select("query_id", "source", "target").distinct()
    e = brought(e)
    now = brought(n.select("query_id", "id", F.lit(0).alias("level")))
    for _ in range(now.count() + 1 if most is None else most):
        up = (
            e.join(now, (e["query_id"] == now["query_id"]) & (e["source"] == now["id"]))
            .groupBy(e["query_id"], e["target"])
            .agg((F.max("level") + 1).alias("up"))
        )
        new = brought(now.join(
            up.select(F.col("query_id").alias("q"), F.col("target").alias("x"), "up"),
            (F.col("query_id") == F.col("q")) & (F.col("id") == F.col("x")),
            "left",
        ).select("query_id", "id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if new.join(now, ["query_id", "id", "level"], "left_anti").isEmpty():
            return new
        now = new
    raise RuntimeError("the levels don't come to an end: a cycle, or too few rounds")


def table_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that a table view shows, and the edges between them."""
    n = nodes.where("node_type in ('table', 'cte', 'output_column')")
    ends = n.select("query_id", "id").distinct()
    e = (
        edges.join(ends.withColumnRenamed("id", "source"), ["query_id", "source"], "left_semi")
        .join(ends.withColumnRenamed("id", "target"), ["query_id", "target"], "left_semi")
    )
    return n, e


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """query_id, id: a node and those one edge away."""
    e = edges.where((F.col("source") == node) | (F.col("target") == node))
    return e.select("query_id", F.explode(F.array("source", "target")).alias("id")).distinct()


def output_tables(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """query_id, output_name, table_id: the tables that each output comes from, by its columns' owners."""
    owner = F.regexp_replace("column_id", r"^column:(.*)\.[^.]*$", "table:$1")  # the id of a column ends with its own part
    return (
        sources.where("segment_index = 0")
        .join(outputs.select("query_id", "ordinal", "output_name"), ["query_id", "ordinal"])
        .select("query_id", "output_name", owner.alias("table_id"))
        .distinct()
    )


def layout(nodes: DataFrame) -> DataFrame:
    """query_id, id, x, y: columns by node type, one row of 58 below the other within a query."""
    x = (
        F.when(F.col("node_type").isin("table", "cte"), 48)
        .when(F.col("node_type") == "column", 270)
        .when(F.col("node_type") == "output_column", 560)
        .otherwise(160)
    )
    rank = (
        F.when(F.col("node_type").isin("table", "cte"), 0)
        .when(F.col("node_type") == "column", 1)
        .when(F.col("node_type") == "output_column", 3)
        .otherwise(2)
    )
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(rank, "id")) - 1
    return nodes.select("query_id", "id", x.cast("bigint").alias("x"), (at * 58 + 72).cast("bigint").alias("y"))


def result_view(nodes: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a table view's result: one node a query beside the outputs, at the tables' mean height, and an edge from each table."""
    tables = nodes.where("node_type = 'table'").select("query_id", "id").distinct()
    at = tables.join(placed, ["query_id", "id"]).groupBy("query_id").agg(F.avg("y").alias("y"))
    result = F.concat(F.lit("result:"), "query_id")
    return at.select(
        "query_id",
        result.alias("id"),
        F.lit(560).cast("bigint").alias("x"),
        "y",
    ), tables.select("query_id", F.col("id").alias("source"), result.alias("target"))


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label or id holds a text."""
    return nodes.where(F.lower(F.concat_ws(" ", "label", "id")).contains(text.lower()))


def highlights(nodes: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    """query_id, id: what a view marks - expressions and what they touch, nodes that could not be resolved, or CTEs and the ends of joins."""
    if mode == "expression":
        own = nodes.where("node_type = 'expression'").select("query_id", "id").distinct()
    elif mode == "diagnostics":
        own = nodes.where("node_type = 'unknown'").select("query_id", "id").distinct()
    elif mode == "semantics":
        joined = edges.where("edge_type = 'join_condition'").select("query_id", F.explode(F.array("source", "target")).alias("id"))
        return nodes.where("node_type = 'cte'").select("query_id", "id").unionByName(joined).distinct()
    else:
        raise ValueError(f"no marks for the view {mode!r}")
    ends = (
        edges.select("query_id", F.col("source").alias("id"), F.col("target").alias("other"))
        .unionByName(edges.select("query_id", F.col("target").alias("id"), F.col("source").alias("other")))
    )
    return own.unionByName(ends.join(own, ["query_id", "id"]).select("query_id", F.col("other").alias("id"))).distinct()
