"""The analysis of networks: validate, read out, remove edges, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import checks, kernel, network, selection
from ..shared import stored


def analyze(nodes: DataFrame, edges: DataFrame, with_removal: bool = True, validate: bool = True, require_converged: bool = False, cubes: bool = False) -> dict[str, DataFrame]:
    """readout, critical, removal (if asked) and ranked candidates of all graphs.

    Nodes, edges and the readout are stored once; everything else is derived from them.  ``cubes`` takes critical
    edges and removals by bounded cubes (see ``network.edge_removal``), not by lattices and converged thresholds.
    """
    nodes, edges = stored(nodes), stored(edges)
    if validate:
        checks.validate_graphs(nodes, edges)
    readout = stored(network.readout(nodes, edges, figures=kernel.CUBE_FIGURES if cubes else kernel.FIGURES))
    if require_converged:
        checks.require_none(readout.where("not converged").select("graph_id", "status"), "readouts that did not converge")
    critical = network.critical_edges(readout)
    out = {"readout": readout, "critical": critical}
    if with_removal:
        out["removal"] = network.edge_removal(nodes, edges, readout, strict=require_converged, cubes=cubes)
    out["ranked"] = selection.rank_candidates(edges, critical, out.get("removal"))
    return out
