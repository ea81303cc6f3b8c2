import numpy as np
import pytest

from percolith.operators import candidates, features
from percolith.plans import governance, trial

CELL = [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]


def structure(coords, elements=("Na", "Na", "Cl")):
    return {"lattice_mat": CELL, "elements": list(elements), "coords": coords, "cartesian": False}


def records():
    """Two hops of one host, one of another, and one that moves two atoms."""
    start = [[0.0, 0.0, 0.0], [0.5, 0.0, 0.0], [0.5, 0.5, 0.5]]
    first = [[0.0, 0.5, 0.0], [0.5, 0.0, 0.0], [0.5, 0.5, 0.5]]
    second = [[0.0, 0.0, 0.0], [0.5, 0.0, 0.5], [0.5, 0.5, 0.5]]
    two = [[0.0, 0.5, 0.0], [0.5, 0.5, 0.0], [0.5, 0.5, 0.5]]
    rows = [(0, 0.3, start, first, ("Na", "Na", "Cl")), (1, 0.4, start, second, ("Na", "Na", "Cl")), (2, 0.5, start, first, ("Li", "Li", "Cl")), (3, 0.6, start, two, ("Na", "Na", "Cl"))]
    return [(k, f"j{k}", "Na2Cl" if e[0] == "Na" else "Li2Cl", t, "PBE", "@a{K,}", "c", "n", "P1", structure(a, e), structure(b, e)) for k, t, a, b, e in rows]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(records(), governance.RAW)


def test_transitions(raw):
    out = {r.raw_index: r for r in candidates.transitions(raw).collect()}
    assert out[0].graph_safe and out[0].migrating_species == "Na" and out[0].hop_distance == pytest.approx(2.0) and out[0].moved_atoms == 1
    assert not out[3].graph_safe and out[3].moved_atoms == 2


def test_graphs_of_hosts(spark, raw, tmp_path):
    out = {k: v.collect() for k, v in trial.build_graphs(raw, at_least=1).items()}
    hosts = {r.migrating_species: r for r in out["summary"]}
    assert set(hosts) == {"Na", "Li"} and hosts["Na"].n_nodes == 4 and hosts["Li"].n_nodes == 3 and hosts["Na"].status == "PREDICTED_BARRIER_COVERAGE_INCOMPLETE"
    mine = [e for e in out["edges"] if e.graph_id == hosts["Na"].graph_id]
    assert sum(e.is_labeled for e in mine) == 2 and not any(e.forced for e in mine) and len({e.edge_uid for e in mine}) == len(mine)
    places = {n.node_id: np.array(n.frac_coords) for n in out["nodes"]}
    for e in mine:
        d = (places[e.node_j] + [e.a, e.b, e.c] - places[e.node_i]) @ np.array(CELL)
        assert np.linalg.norm(d) == pytest.approx(e.hop_distance) and e.hop_distance <= e.cutoff + 1e-9
    # every pair within the cutoff is there, once
    n = {k: v for k, v in places.items() if k.startswith(hosts["Na"].graph_id)}
    near = {min((i, j, s), (j, i, tuple(-x for x in s))) for i in n for j in n for s in candidates.all_shifts(2) if 1e-3 < np.linalg.norm((n[j] + s - n[i]) @ np.array(CELL)) <= hosts["Na"].cutoff + 1e-12}
    assert near == {(e.node_i, e.node_j, (e.a, e.b, e.c)) for e in mine}
    assert {x.record_id for x in out["paths"]} == {f"em_complete_{k:04d}_jid_j{k}" for k in (0, 1, 2)}
    assert set(trial.run(raw, str(tmp_path))) == {"nodes", "edges", "paths", "summary"}


def test_start_atoms_in_a_skewed_cell(spark):
    skew = [[4.0, 0.0, 0.0], [3.9, 1.0, 0.0], [0.0, 0.0, 5.0]]
    s = {"lattice_mat": skew, "elements": ["Na", "Cl"], "coords": [[0.0, 0.0, 0.0], [0.3, 0.3, 0.3]], "cartesian": False}
    kind = governance.STRUCTURE.simpleString()
    rows = [("x", s, "Na", [0.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0, 0, 0]), ("y", s, "Na", [0.5, 0.5, 0.0], [1.0, 0.0, 0.0], [1, 0, 0]), ("z", s, "Na", [0.2, 0.2, 0.2], [0.4, 0.4, 0.4], [0, 0, 0])]
    df = spark.createDataFrame(rows, f"key string, structure {kind}, migrating_species string, start_frac array<double>, end_frac array<double>, image_shift array<int>")
    out = {r.key: r for r in features.start_atoms(df, 0.2).collect()}
    assert out["x"].moving_atom_index == 0 and not out["x"].turned
    assert out["y"].turned and out["y"].start_frac == [1.0, 0.0, 0.0] and out["y"].image_shift == [-1, 0, 0]
    assert out["z"].moving_atom_index is None and not out["z"].turned


def test_feature_tables(spark):
    s = structure([[0.0, 0.0, 0.0], [0.5, 0.0, 0.0], [0.5, 0.5, 0.5]])
    kind = governance.STRUCTURE.simpleString()
    hops = spark.createDataFrame([("k", s, "Na", [0.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0, 0, 0], 0)], f"key string, structure {kind}, migrating_species string, start_frac array<double>, end_frac array<double>, image_shift array<int>, moving_atom_index int")
    table = spark.createDataFrame([("Na", 1.9, 11.0), ("Cl", None, 17.0)], "symbol string, atomic_radius_A double, atomic_number double")
    blocks = features.path_block(hops, table, ["Na", "Cl"], ["atomic_number"])
    f = blocks.first().features
    assert f["D_endpoint_to_nearest_other_mobile_A"] == pytest.approx(np.sqrt(8)) and f["D_ordered_coordinate_configuration_available_indicator"] == 1.0
    assert "D_explicit_vacancy_fraction" not in f and f["B_straight_path_clearance_proxy_missing_indicator"] == 1.0 and "signed_clearance_A" not in f
    wide = features.widened(blocks, ["B_hop_distance_A", "signed_clearance_A"])
    assert wide.first().B_hop_distance_A == pytest.approx(2.0) and wide.first().signed_clearance_A is None
    schema = {r.column: r for r in features.feature_schema(wide, {"key": "id"}).collect()}
    assert schema["B_hop_distance_A"].unit == "A" and schema["signed_clearance_A"].nullable and schema["key"].role == "id"
