"""Closures and levels end with all nodes or with an error."""

import pytest

from loomtrace.operators import graph


def test_rounds_that_run_out(spark):
    edges = spark.createDataFrame([("q", f"table:{i}", f"table:{i + 1}") for i in range(4)], "query_id string, source string, target string")
    assert {r.id: r.distance for r in graph.closure(edges, "table:4").collect()} == {f"table:{i}": 4 - i for i in range(4)}
    with pytest.raises(RuntimeError):
        graph.closure(edges, "table:4", most=2)
    ring = spark.createDataFrame([("q", "table:0", "table:1"), ("q", "table:1", "table:0")], edges.schema)
    nodes = spark.createDataFrame([("q", f"table:{i}", "cte") for i in range(2)], "query_id string, id string, node_type string")
    with pytest.raises(RuntimeError):
        graph.levels(nodes, ring)
