"""Readouts of networks that arrive as a stream of edges: an extension, with the batch plan in every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import network


def stream_readouts(edges: DataFrame, nodes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that reads out the graphs of each micro-batch and hands them to ``write``.

    A batch holds whole graphs (one file a graph, say); ``nodes`` is the static side.  The checkpoint makes
    a restart resume after the last batch that was written.
    """
    def batch(df: DataFrame, number: int) -> None:
        seen = df.select("graph_id").distinct()
        write(network.readout(nodes.join(seen, "graph_id", "left_semi"), df), number)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
