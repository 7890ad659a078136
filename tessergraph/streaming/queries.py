"""Retrieval for a stream of queries: each micro-batch runs the bounded loop against one shared index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessergraph.plans import retrieve
from tessergraph.sources.durable import drop_materialized


def retrieve_stream(queries: DataFrame, pairs: DataFrame, nodes: DataFrame, edges: DataFrame, output: str, checkpoint: str, budget: retrieve.Budget = retrieve.Budget()) -> StreamingQuery:
    """Writes a result row for each query of a stream (dataset, query_id, query, embedding) to Parquet folders ``batch=N``.

    The index is written once, before the stream starts. A micro-batch that is run again replaces its own folder.
    """
    index = retrieve.graph_index(pairs, nodes, edges)
    vectors = retrieve.materialize(pairs.select("dataset", "pair_id", "embedding"))

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        rows = retrieve.materialize(rows)
        own = retrieve.with_scores(index, (rows.select(*retrieve.IDS, "embedding"), vectors))
        asked = rows.select(*retrieve.IDS, "query")
        ranked, state, seeds = retrieve.retrieve(asked, own, budget)
        retrieve.results(asked, own, ranked, state, seeds).write.mode("overwrite").parquet(f"{output}/batch={number}")
        for df in (rows, own.best, state.held):
            drop_materialized(df)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
