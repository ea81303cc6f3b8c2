import pytest

from percolith.operators import checks, kernel, network, selection
from percolith.plans.analyze import analyze
from percolith.schemas import AXES

EDGE = "graph_id string, edge_uid string, node_i string, node_j string, a int, b int, c int, barrier double"


@pytest.fixture(scope="module")
def two(spark):
    nodes = spark.createDataFrame([("flat", "n0"), ("chain", "p"), ("chain", "q"), ("bare", "z")], "graph_id string, node_id string")
    rows = [("flat", "ea", "n0", "n0", 1, 0, 0, 0.2), ("flat", "eb", "n0", "n0", 0, 1, 0, 0.3), ("chain", "e1", "p", "q", 0, 0, 0, 0.1), ("chain", "e2", "q", "p", 1, 0, 0, 0.4), ("chain", "e3", "q", "p", 1, 0, 0, 0.7)]
    return nodes, spark.createDataFrame(rows, EDGE)


def test_readout(two):
    out = {r.graph_id: r for r in network.readout(*two).collect()}
    assert (out["flat"].winding_rank, out["flat"].eperc_a, out["flat"].eperc_b, out["flat"].eperc_c) == (2, 0.2, 0.3, None)
    assert (out["chain"].winding_rank, out["chain"].eperc_a, out["chain"].redundancy) == (1, 0.4, 1)
    assert out["bare"].status == "PASSED" and out["bare"].winding_rank == 0 and out["bare"].n_edges == 0


def test_removal(two):
    out = {(r.graph_id, r.edge_uid): r for r in network.edge_removal(*two).collect()}
    assert len(out) == 5
    assert out["flat", "ea"].lost_a and out["flat", "ea"].rank_loss == 1 and not out["flat", "ea"].lost_b
    assert out["chain", "e2"].delta_eperc_a == pytest.approx(0.3) and out["chain", "e2"].rank_loss == 0
    assert out["chain", "e3"].screen_status == "NONCRITICAL_ZERO_SCREENED" and out["chain", "e3"].delta_eperc_a == 0


def test_removal_of_an_only_edge(spark):
    nodes = spark.createDataFrame([("g", "n")], "graph_id string, node_id string")
    edges = spark.createDataFrame([("g", "e", "n", "n", 1, 0, 0, 0.5)], EDGE)
    row = network.edge_removal(nodes, edges).first()
    assert row.lost_a and row.rank_loss == 1


def test_removals_must_converge(spark):
    nodes = spark.createDataFrame([("g", "n")], "graph_id string, node_id string")
    rows = [("g", "e2", "n", "n", 2, 0, 0, 0.1), ("g", "e3", "n", "n", 3, 0, 0, 0.2)]
    edges = spark.createDataFrame(rows, EDGE)
    read = network.readout(nodes, edges).first()
    assert (read.eperc_a_exact, read.eperc_a_r2, read.eperc_a_r1, read.status) == (0.2, 0.2, None, "SUPERCELL_NOT_CONVERGED")
    with pytest.raises(checks.CheckError):
        network.edge_removal(nodes, edges)
    loose = network.edge_removal(nodes, edges, strict=False).collect()
    assert all(r.lost_a is None and r.delta_eperc_a is None for r in loose)
    # the baseline converges through a shorter loop; without it the others don't
    with pytest.raises(checks.CheckError):
        network.edge_removal(nodes, spark.createDataFrame([*rows, ("g", "e1", "n", "n", 1, 0, 0, 0.05)], EDGE))


def test_fields_of_a_readout(two):
    out = {r.graph_id: r for r in network.readout(*two).collect()}
    assert out["flat"].periodic_dimensionality == "2D" and out["flat"].winding_vectors == [[0, 1, 0], [1, 0, 0]] and out["flat"].missing_barrier_edge_uids == []
    assert out["chain"].supercell_r1.asDict() == {"cells": 27, "node_images": 54, "edge_images": 27 + 18 + 18}
    part = {r.graph_id: r for r in network.readout(*two, figures=("r1",)).collect()}
    assert part["chain"].eperc_a_r1 == 0.4 and part["chain"].eperc_a_exact is None and part["chain"].winding_rank is None
    assert {(r.graph_id, r.edge_uid) for r in network.bridges(*two).collect()} == set()
    assert {(r.graph_id, r.edge_uid) for r in network.bridges(two[0], two[1].where("edge_uid in ('ea', 'e1')")).collect()} == {("chain", "e1")}
    assert kernel.minor_gcds([(2, 0, 0), (0, 3, 0)]) == [1, 6] and kernel.minor_gcds([(2, 0, 0), (4, 0, 0)]) == [2] and kernel.minor_gcds([]) == []


def test_missing_barriers_are_named(two, spark):
    edges = two[1].unionByName(spark.createDataFrame([("flat", "ez", "n0", "n0", 0, 0, 1, None)], EDGE))
    row = network.readout(two[0], edges).where("graph_id = 'flat'").first()
    assert row.status == "PREDICTED_BARRIER_COVERAGE_INCOMPLETE" and row.missing_barrier_edge_uids == ["ez"] and row.periodic_dimensionality is None


def test_removal_by_score_and_first_threshold(two, spark):
    scored = two[1].withColumn("s", -two[1]["barrier"])
    out = network.removal_response(two[0], scored, [0.0, 0.34, 1.0], "s", repeats=3)
    ranked = {(r.graph_id, r.fraction): r.largest for r in out.where("strategy = 'ranked'").collect()}
    assert ranked["chain", 0.0] == 1.0 and ranked["chain", 0.34] == 1.0 and ranked["chain", 1.0] == 0.5
    assert network.mean_response(out).count() == 3 * 2 * 3
    f = network.largest_fraction(*two, [0.05, 0.1, 0.4])
    assert {r.graph_id: r.threshold for r in network.first_threshold(f, 0.9).collect()} == {"flat": 0.05, "chain": 0.1, "bare": 0.05}


def test_removal_response_is_whole(spark):
    from percolith.plans.operator_queries import graph_removal_response

    out = graph_removal_response(spark, "/root/testdata/sf0.001").collect()
    shares = {k / 10 for k in range(9)}
    assert {(r.strategy, r.fraction, r.repeat) for r in out} == {("ranked", f, 0) for f in shares} | {("random", f, k) for f in shares for k in range(80)}
    assert len(out) == 729 * len({r.graph_id for r in out})


def test_canonical_and_directed(two, spark):
    edges = two[1]
    both = network.directed(edges)
    assert both.count() == 10
    once = network.canonical(both).dropDuplicates(["graph_id", "edge_uid", "node_i", "node_j", *AXES])
    assert once.count() == 5


def test_analysis_ranks(two):
    out = analyze(*two)
    ranked = {(r.graph_id, r.edge_uid): r for r in out["ranked"].collect()}
    assert ranked["chain", "e1"].exploit_rank == 1 and ranked["chain", "e3"].critical == 0
    assert ranked["flat", "ea"].max_delta == pytest.approx(1.3)


def test_labelled_edges_count_but_are_not_ranked(two, spark):
    from pyspark.sql import functions as F

    out = selection.rank_candidates(two[1].withColumn("is_labeled", F.col("edge_uid") == "e1")).where("graph_id = 'chain'").collect()
    assert {r.edge_uid for r in out} == {"e2", "e3"}
    assert {round(r.low, 9) for r in out} == {round(1 - 2 / 3, 9), 0.0}


@pytest.mark.parametrize("bad", [("g", "e", "n", "n", 0, 0, 0, 0.1), ("g", "e", "n", "x", 1, 0, 0, 0.1), ("g", "e", "n", "n", 1, 0, 0, -0.1), ("g", "e", "n", "n", 1, 0, 0, float("nan"))])
def test_bad_graphs_are_rejected(spark, bad):
    nodes = spark.createDataFrame([("g", "n")], "graph_id string, node_id string")
    with pytest.raises(checks.CheckError):
        checks.validate_graphs(nodes, spark.createDataFrame([bad], EDGE))


def test_intervals_follow_their_scenario(two):
    from pyspark.sql import functions as F

    edges = two[1].withColumns({"lower": F.col("barrier") * 0.5, "upper": F.col("barrier") * 2})
    out = {(r.graph_id, r.scenario): r.eperc_a for r in network.interval_readouts(two[0], edges, {"point": "barrier", "lower": "lower", "upper": "upper"}).collect()}
    assert out["flat", "lower"] == 0.1 and out["flat", "upper"] == 0.4


def test_stream_reads_out_every_batch(two, spark, tmp_path):
    from percolith.streaming.readouts import stream_readouts

    two[1].write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(two[1].schema).parquet(str(tmp_path / "in"))
    stream_readouts(stream, two[0], lambda df, k: seen.extend(r.graph_id for r in df.collect()), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(seen) == ["chain", "flat"]
