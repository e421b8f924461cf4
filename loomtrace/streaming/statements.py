"""An extension: statements that arrive as a stream are explained batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.analysis import Analysis


def explain_stream(statements: DataFrame, columns: DataFrame, sink, checkpoint: str):
    """Starts a query over a stream of (query_id, sql); ``sink`` gets each batch's edges.  The texts come to the driver, whose parser
    reads them, a partition at a time; the parsed rows of more than one batch of statements are written as they are made."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            rows = ((r.query_id, r.sql) for r in df.select("query_id", "sql").toLocalIterator())
            sink(Analysis(df.sparkSession, rows, columns).edges, number)

    return statements.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
