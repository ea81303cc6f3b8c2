"""Periodic graphs from raw transition records: hosts, sites, candidate edges, reported paths, gates.

Every step is a join or aggregate over all hosts at once; a host (one crystal) is the unit that Python sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import candidates, checks, network, stats
from ..shared import stored

#: Sites closer than this many angstrom are one; the share of reported hops that a species' cutoff covers, and the records it takes.
NODE_TOLERANCE, COVERED, ENOUGH = 1e-3, 0.95, 5
# Sources of sites.
INITIAL, FINAL = "raw_initial_structure_mobile_site", "reported_neb_final_endpoint"


def cutoffs(moves: DataFrame, probability: float = COVERED, at_least: int = ENOUGH) -> DataFrame:
    """(migrating_species, cutoff, cutoff_source): a species' quantile of reported hops, the overall one where it has few."""
    out = stats.cutoffs(moves.where("graph_safe"), "migrating_species", "hop_distance", probability, at_least)
    return out.select("migrating_species", "cutoff", F.concat_ws(":", F.col("source"), F.col("n").cast("string")).alias("cutoff_source"))


def host_groups(records: DataFrame, moves: DataFrame) -> DataFrame:
    """Safe transitions with their host's graph_id, records in order within each host."""
    rows = records.join(moves.where("graph_safe and not ambiguous"), "raw_index").withColumn("structure", F.col("structure_ini"))
    marked = candidates.host_fingerprint(rows).drop("structure")
    return marked.withColumn("graph_id", T.graph_id(F.col("fingerprint")))


def sites(hosts: DataFrame, tolerance: float = NODE_TOLERANCE) -> DataFrame:
    """Distinct mobile sites of each host: those of initial structures first, in order of record and atom, then reported ends."""
    s = F.col("structure_ini")
    atoms = hosts.select("graph_id", "raw_index", "record_id", s["lattice_mat"].alias("lattice"), "migrating_species", F.posexplode(F.arrays_zip(s["elements"].alias("e"), s["coords"].alias("x"))).alias("atom", "a"))
    start = atoms.where(F.col("a.e") == F.col("migrating_species")).select("graph_id", F.lit(0).alias("late"), "raw_index", "atom", F.col("a.x").alias("frac"), F.lit(INITIAL).alias("source"), "record_id", "lattice")
    end = hosts.select("graph_id", F.lit(1).alias("late"), "raw_index", F.col("atom_index").alias("atom"), F.col("end_frac").alias("frac"), F.lit(FINAL).alias("source"), "record_id", s["lattice_mat"].alias("lattice"))
    both = start.unionByName(end).withColumn("order", F.struct("late", "raw_index", "atom"))
    # a host's sites are one group, and bounded
    first = both.groupBy("graph_id").agg(F.first("lattice").alias("_l"))
    numbered = both.join(first, "graph_id").withColumn("lattice", F.col("_l")).select("graph_id", (F.col("late") * F.lit(1 << 60) + F.col("raw_index") * F.lit(1 << 20) + F.col("atom")).alias("order"), "frac", "source", "record_id", "lattice")
    return candidates.merge_sites(numbered, tolerance)


def build_graphs(records: DataFrame, tolerance: float = NODE_TOLERANCE, at_least: int = ENOUGH) -> dict[str, DataFrame]:
    """nodes, edges, reported paths and summary of the graphs of all hosts.

    ``records`` has raw_index, jid, formula, target, structure_ini and structure_fin.  Raises where the search for
    candidates would miss one, or a reported path's ends are no sites.
    """
    rows = records.withColumn("record_id", T.record_id(F.col("raw_index"), F.col("jid")))
    moves = stored(candidates.transitions(records))
    hosts = stored(host_groups(rows, moves).join(F.broadcast(cutoffs(moves, at_least=at_least)), "migrating_species"))  # a row a species
    nodes = stored(sites(hosts, tolerance))
    cell = hosts.groupBy("graph_id").agg(F.min(F.struct("raw_index", F.col("structure_ini.lattice_mat").alias("lattice"), "cutoff", "cutoff_source", "formula", "migrating_species")).alias("h"))
    cell = cell.select("graph_id", "h.lattice", "h.cutoff", "h.cutoff_source", "h.formula", "h.migrating_species")
    placed = nodes.join(cell, "graph_id")
    checks.require_none(candidates.missed_edges(placed, tolerance).select("graph_id", "node_i", "node_j"), "edges beyond the cells searched")
    found = candidates.candidate_edges(placed, tolerance).join(cell.select("graph_id", "cutoff"), "graph_id")

    ends = hosts.select("graph_id", "raw_index", "record_id", "start_frac", "end_frac", "image_shift", "hop_distance", "cutoff", "target")
    near = _nodes_of(ends, nodes, cell, tolerance)
    checks.require_none(near.where("start_node is null or end_node is null").select("graph_id", "record_id"), "reported ends that are no sites")
    paths = near.select("graph_id", F.col("start_node").alias("node_i"), F.col("end_node").alias("node_j"), *[F.col("image_shift")[k].alias(x) for k, x in enumerate("abc")], "record_id", F.col("target").alias("barrier"), "hop_distance", "cutoff")
    reported = network.canonical(paths)
    merged = candidates.merge_reported(found, reported)
    uid = candidates.edge_identity(F.col("graph_id"), F.col("node_i"), F.col("node_j"), F.array("a", "b", "c"))
    edges = stored(merged.withColumns({"edge_uid": uid, "barrier": F.lit(None).cast("double")}))
    checks.require_none(checks.duplicate_keys(edges, ["graph_id", "edge_uid"]), "repeated edges")
    readout = network.readout(nodes.select("graph_id", "node_id"), edges.select("graph_id", "edge_uid", "node_i", "node_j", "a", "b", "c", "barrier"))
    figures = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.count_if("is_labeled").alias("n_labeled_edges"), F.count_if("forced").alias("n_forced_reported_edges"))
    summary = cell.drop("lattice").join(nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes")), "graph_id").join(figures, "graph_id", "left").join(readout.select("graph_id", "status", "barrier_coverage"), "graph_id")
    return {"nodes": nodes, "edges": edges, "paths": reported, "summary": summary}


def _nodes_of(ends: DataFrame, nodes: DataFrame, cell: DataFrame, tolerance: float) -> DataFrame:
    """Transitions with the nodes at their ends; nodes and their order are those of one host."""
    lists = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "frac_coords"))).alias("sites"))

    def run(tables):
        import numpy as np

        for t in tables:
            out = t.drop(columns=["sites", "lattice"])
            for place, name in (("start_frac", "start_node"), ("end_frac", "end_node")):
                found = []
                for x, mine, lattice in zip(t[place], t["sites"], t["lattice"], strict=True):
                    d = candidates.image_distances(x, np.array([list(s["frac_coords"]) for s in mine]), np.array([list(r) for r in lattice], float))
                    at = np.flatnonzero(d <= tolerance)
                    found.append(mine[at[0]]["node_id"] if len(at) else None)
                out[name] = found
            yield out

    rows = ends.join(lists, "graph_id").join(cell.select("graph_id", "lattice"), "graph_id")
    kept = [f for f in rows.schema.fields if f.name not in ("sites", "lattice")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", start_node string, end_node string"
    return rows.select(*[f.name for f in kept], "sites", "lattice").mapInPandas(run, schema)


def run(records: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The whole job: every table written with its sidecars."""
    from ..sources import sinks

    out = build_graphs(records)
    for name, df in out.items():
        sinks.write_csv_artifacts(df, f"{folder}/{name}")
    return out


def hop_lengths(edges: DataFrame, nodes: DataFrame, lattices: DataFrame) -> DataFrame:
    """Edges with displacement_frac, displacement_cart and their length, from the nodes' places."""
    ends = edges.join(nodes.select("graph_id", F.col("node_id").alias("node_i"), F.col("frac_coords").alias("fi")), ["graph_id", "node_i"]).join(nodes.select("graph_id", F.col("node_id").alias("node_j"), F.col("frac_coords").alias("fj")), ["graph_id", "node_j"])
    step = V.add3(V.subtract3(F.col("fj"), F.col("fi")), F.array(*[F.col(x).cast("double") for x in "abc"]))
    out = ends.join(lattices.select("graph_id", "lattice"), "graph_id").withColumn("displacement_frac", step)
    out = out.withColumn("displacement_cart", V.to_cartesian(F.col("displacement_frac"), F.col("lattice")))
    return out.withColumn("length", V.norm(F.col("displacement_cart"))).drop("fi", "fj", "lattice")
