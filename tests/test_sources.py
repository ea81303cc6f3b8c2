import hashlib
import json
import math

import numpy as np
import pytest

from percolith.functions import text as T
from percolith.operators import candidates, checks, features, network
from percolith.sources import readers, sinks

CIF = """data_x
_cell_length_a   4.0
_cell_length_b   5.0(1)
_cell_length_c   6.0
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
_space_group_name_H-M_alt 'P 1'
loop_
_atom_site_type_symbol
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na Na1 0.0 0.0 0.0
Cl Cl1 0.5 0.5 -0.5
"""
POSCAR = """x
1.0
4 0 0
0 5 0
0 0 6
Na Cl
1 1
Cartesian
0 0 0
2 2.5 -3
"""


def graph(**over):
    base = {"schema_version": 1, "kind": "periodic_graph", "name": "x", "graph_id": "g", "nodes": [{"id": "s", "frac_coords": [0, 0, -0.5]}], "edges": [{"edge_uid": "", "node_i": "s", "node_j": "s", "image_shift": [1, 0, 0], "barrier_eV": 0.2}, {"edge_uid": "b", "node_i": "s", "node_j": "s", "image_shift": [0, 1.0, 0], "barrier_eV": 0.3}]}
    return base | over


def test_project(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(graph()))
    nodes, edges = readers.project_tables(readers.load_projects(spark, str(tmp_path / "p.json")))
    assert [r.edge_uid for r in edges.orderBy("edge_uid").collect()] == ["b", "edge_0001"]
    row = network.readout(nodes, edges).first()
    assert (row.winding_rank, row.eperc_a, row.eperc_b, row.eperc_c) == (2, 0.2, 0.3, None)


@pytest.mark.parametrize("change", [{"schema_version": 2}, {"kind": "other"}])
def test_unknown_projects_are_rejected(spark, tmp_path, change):
    (tmp_path / "p.json").write_text(json.dumps(graph(**change)))
    with pytest.raises(checks.CheckError):
        readers.load_projects(spark, str(tmp_path / "p.json"))


def test_fractional_shift_is_rejected(spark, tmp_path):
    doc = graph()
    doc["edges"][0]["image_shift"] = [0.5, 0, 0]
    (tmp_path / "p.json").write_text(json.dumps(doc))
    with pytest.raises(checks.CheckError):
        readers.project_tables(readers.load_projects(spark, str(tmp_path / "p.json")))


def test_path_project_checks_its_atoms(spark, tmp_path):
    structure = {"lattice_mat": [[4, 0, 0], [0, 4, 0], [0, 0, 4]], "elements": ["Na", "Cl", "Na"], "coords": [[0, 0, 0], [0.5, 0.5, 0.5], [0.5, 0, 0]], "cartesian": False}
    def doc(end, atom=0):
        return graph(kind="path_project", migrating_species="Na", structure=structure, nodes=[{"id": "i", "frac_coords": [0, 0, 0]}, {"id": "j", "frac_coords": end}], edges=[{"edge_uid": "e", "node_i": "i", "node_j": "j", "image_shift": [0, 0, 0], "moving_atom_index": atom, "is_labeled": False}])
    for name, end, atom, good in (("a", [0, 0.5, 0], 0, True), ("b", [0.5, 0, 0], 0, False), ("c", [0, 0.5, 0], 1, False), ("d", [0, 0.5, 0], 2, False)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc(end, atom)))
        projects = readers.load_projects(spark, str(path))
        if good:
            assert readers.project_tables(projects)[1].count() == 1
        else:
            with pytest.raises(checks.CheckError):
                readers.project_tables(projects)


def test_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text('﻿graph_id,node_id,frac_coords\ng,s,"[0,0,0]"\n', encoding="utf-8")
    (tmp_path / "e.csv").write_text("﻿graph_id,edge_uid,node_i,node_j,image_shift_a,image_shift_b,image_shift_c,barrier_eV,other\ng,x,s,s,1,0,0,0.2,\ng,y,s,s,0,1,0,0.3,9\n", encoding="utf-8")
    nodes, edges = readers.load_graph_csv(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert network.readout(nodes, edges).first().eperc_b == 0.3
    _, other = readers.load_graph_csv(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"), "other")
    assert network.readout(nodes, other).first().status == "PREDICTED_BARRIER_COVERAGE_INCOMPLETE"
    (tmp_path / "n2.csv").write_text('graph_id,node_id,frac_coords\nh,s,"[0,0,0]"\n')
    with pytest.raises(checks.CheckError):
        readers.load_graph_csv(spark, str(tmp_path / "n2.csv"), str(tmp_path / "e.csv"))


def test_structures(spark, tmp_path):
    a, b = readers.parse_cif(CIF), readers.parse_poscar(POSCAR)
    assert a["elements"] == b["elements"] == ["Na", "Cl"]
    assert np.allclose(a["coords"], b["coords"]) and np.allclose(a["lattice_mat"], b["lattice_mat"], atol=1e-9)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.cif").write_text(CIF)
    (tmp_path / "in" / "x.vasp").write_text(POSCAR)
    found = readers.load_structures(spark, str(tmp_path / "in"))
    assert found.count() == 2
    project = readers.project_from_structure(found.limit(1), "Na", 0, [0, 0.5, 0.5], [0, 0, 0])
    nodes, edges = readers.project_tables(project)
    assert nodes.count() == 2 and edges.first().barrier is None


def test_minimum_image_in_a_skewed_cell():
    lattice = np.array([[4.0, 0, 0], [3.9, 1.0, 0], [0, 0, 5.0]])
    out = candidates.minimum_image([0, 0, 0], [0.5, 0.5, 0], lattice)
    best = min(np.linalg.norm((np.array([0.5, 0.5, 0]) + s) @ lattice) for s in candidates.all_shifts(6))
    assert out["distance"] == pytest.approx(best)
    assert candidates.image_distances([0, 0, 0], np.array([[0.5, 0.5, 0]]), lattice)[0] == pytest.approx(best)


def test_candidate_edges_of_a_cubic_site(spark):
    rows = [("g", "n0", [0.0, 0.0, 0.0], [[3.0, 0.0, 0.0], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0]], 3.0), ("g", "n1", [0.5, 0.5, 0.5], [[3.0, 0.0, 0.0], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0]], 3.0)]
    nodes = spark.createDataFrame(rows, "graph_id string, node_id string, frac_coords array<double>, lattice array<array<double>>, cutoff double")
    out = candidates.candidate_edges(nodes)
    assert out.count() == 3 + 3 + 8
    assert out.where("node_i = node_j").where("a + b + c > 0").count() == 0
    assert candidates.missed_edges(nodes).count() == 0


def test_merge_sites_and_reported(spark):
    cell = [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]]
    sites = spark.createDataFrame([("g", 0, [0.0, 0.0, 0.0], "s", "r1", cell), ("g", 1, [0.9999, 0.0, 0.0], "s", "r2", cell), ("g", 2, [0.5, 0.0, 0.0], "s", "r1", cell)], "graph_id string, order int, frac array<double>, source string, record_id string, lattice array<array<double>>")
    out = candidates.merge_sites(sites, 0.01).orderBy("node_id").collect()
    assert [r.record_ids for r in out] == [["r1", "r2"], ["r1"]]
    key = "graph_id string, node_i string, node_j string, a int, b int, c int"
    hop = ", hop_distance double, cutoff double"
    edges = spark.createDataFrame([("g", "n0", "n1", 0, 0, 0, 2.0, 3.0), ("g", "n1", "n1", -1, 0, 0, 3.0, 3.0)], key + hop)
    reported = spark.createDataFrame([("g", "n0", "n1", 0, 0, 0, 2.0, 3.0, "r1", 0.3), ("g", "n0", "n0", -1, 0, 0, 4.0, 3.0, "r2", 0.5), ("g", "n0", "n2", 0, 0, 0, 3.0, 3.0, "r3", 0.1)], key + hop + ", record_id string, barrier double")
    merged = {(r.node_i, r.node_j): (r.is_labeled, r.forced, r.edge_source) for r in candidates.merge_reported(edges, reported).collect()}
    assert merged == {
        ("n0", "n1"): (True, False, candidates.REPORTED), ("n1", "n1"): (False, False, candidates.ENUMERATED),
        ("n0", "n0"): (True, True, candidates.FORCED), ("n0", "n2"): (True, False, candidates.REPORTED),  # within the cutoff, so not forced
    }


def test_images_in_random_cells():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lattice = rng.normal(size=(3, 3)) * rng.choice([0.3, 1, 4], size=(3, 1)) + rng.integers(-2, 3, (3, 3))
        if abs(np.linalg.det(lattice)) < 0.3:
            continue
        a, b = rng.uniform(-2, 2, 3), rng.uniform(-2, 2, 3)
        base = np.mod(b, 1) - np.mod(a, 1)
        every = np.linalg.norm((base + np.array(candidates.all_shifts(9))) @ lattice, axis=1).min()
        out = candidates.minimum_image(a, b, lattice)
        assert out["distance"] <= every + 1e-9 and np.linalg.norm((base + out["shift"]) @ lattice) == pytest.approx(out["distance"])
        assert candidates.image_distances(a, b, lattice)[0] == pytest.approx(out["distance"])
    tied = candidates.minimum_image([0, 0, 0], [0.5, 0, 0], np.eye(3))
    assert tied["shift"] == (0, 0, 0) and tied["ties"] == 2  # the hint
    assert candidates.minimum_image([0, 0, 0], [1.5, 0, 0], np.eye(3))["shift"] == (-1, 0, 0)  # no hint among them: the first


def test_text_functions(spark):
    from pyspark.sql import functions as F

    good = {"Na4Cl4": "NaCl", "Cl2Na4": "ClNa2", "Li0.5O1": "LiO2", "CH3CH3": "CH3CH3", "Na 2 Cl2": "NaCl", "NaCl": "NaCl", "Li2": "Li"}
    assert {x: T.reduce_formula(x) for x in good} == good
    for bad in ("Foo!", "xyz", "Li(PO4)3", "", "Na0", "2Na"):
        with pytest.raises(ValueError):
            T.reduce_formula(bad)
    assert T.canonical({"b": 1, "a": [1.0]}) == '{"a":[1.0],"b":1}'
    rows = [("@article{Key2020, x}", "Key2020"), ("@misc{SELF,}", "SELF"), (" self ", "SELF"), ("none", "?"), (None, "?")]
    assert [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(T.source_group(F.col("x"), F.lit("?"))).collect()] == [y for _, y in rows]
    numbers = [("1.5e3 K", 1.5), ("1.5e3", 1500.0), ("-3", -3.0), (" 2.50 ", 2.5), ("about +7.25 eV", 7.25), ("nan", None), ("inf", None), ("1e999", None), ("none", None), (None, None), ("12.", 12.0), ("5d", 5.0), (".5", 0.5)]
    assert [r[0] for r in spark.createDataFrame(numbers, "x string, y double").select(T.first_number(F.col("x"))).collect()] == [y for _, y in numbers]
    metals = [("Alkali Metal ", 1.0), ("lanthanoid", 1.0), ("transition metal", 1.0), ("metalloid", 0.0), ("yes", 0.0), ("1", 0.0), (None, 0.0), ("nonmetal", 0.0)]
    assert [r[0] for r in spark.createDataFrame(metals, "x string, y double").select(T.is_metal(F.col("x"))).collect()] == [y for _, y in metals]
    families = [("spinels", "SPINEL"), ("  a  b ", "A B"), ("", "UNSPECIFIED")]
    assert [r[0] for r in spark.createDataFrame(families, "x string, y string").select(T.family(F.col("x"))).collect()] == [y for _, y in families]
    payload = spark.range(1).select(F.to_json(F.struct(F.lit(2).alias("b"), F.lit("x").alias("a"))).alias("p"))
    expected = hashlib.sha256(b'{"a":"x","b":2}').hexdigest()[:20]
    assert payload.select(T.stable_id("k", F.col("p"))).first()[0] == f"k_{expected}"


def test_leaking_names():
    names = ["Hop Distance", "predicted_barrier_eV", "source group id", "resource", "A_x"]
    assert checks.leaking_names(names, patterns=["barrier"], names=["source group"]) == ["predicted_barrier_eV", "source group id"]
    assert checks.leaking_names(names, allowed=["A_x"]) == sorted(set(names) - {"A_x"})
    with pytest.raises(checks.CheckError):
        checks.require_no_leakage(names, patterns=["barrier"])
    checks.require_partition(["a", "b"], {"x": ["a"], "y": ["b"]})
    with pytest.raises(checks.CheckError):
        checks.require_partition(["a", "b"], {"x": ["a"], "y": ["a", "b"]})


def test_features(spark):
    from percolith.schemas import STRUCTURE

    structure = {"lattice_mat": [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]], "elements": ["Na", "Cl", "Na"], "coords": [[0.0, 0.0, 0.0], [0.5, 0.5, 0.5], [0.5, 0.0, 0.0]], "cartesian": False}
    hops = spark.createDataFrame([("k", structure, "Na", [0.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0, 0, 0], 0)], f"key string, structure {STRUCTURE.simpleString()}, migrating_species string, start_frac array<double>, end_frac array<double>, image_shift array<int>, moving_atom_index int")
    table = spark.createDataFrame([("Na", 1.9, 11.0), ("Cl", 1.0, 17.0)], "symbol string, atomic_radius_A double, atomic_number double")
    f = features.path_block(hops, table, ["Na", "Cl"], ["atomic_radius_A", "atomic_number"]).first().features
    assert f["B_hop_distance_A"] == pytest.approx(2.0) and f["D_initial_mobile_site_count"] == 2
    assert f["B_end_nearest_1_A"] == pytest.approx(math.sqrt(8)) and f["overlap_flag"] in (0.0, 1.0)
    a = features.composition_block(hops, table, ["Na", "Cl"], ["atomic_number"]).first()
    assert a.A_atom_count == 3 and a.A_all_atomic_number_mean == pytest.approx(13.0) and a.A_host_atomic_number_mean == 17.0
    assert a.A_composition_entropy == pytest.approx(-(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3))
    with pytest.raises(Exception, match="unknown elements"):
        features.path_block(hops, table.where("symbol = 'Na'"), ["Na"], ["atomic_radius_A"]).collect()


def test_governance(spark, tmp_path):
    from percolith.plans import governance

    s = {"lattice_mat": [[4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]], "elements": ["Na"], "coords": [[0.0, 0.0, 0.0]], "cartesian": False}
    bad = s | {"elements": []}
    moved = s | {"elements": ["Na", "Cl"], "coords": [[0.9, 0.0, 0.0], [0.5, 0.5, 0.5]]}
    ini = moved | {"coords": [[0.1, 0.0, 0.0], [0.5, 0.5, 0.5]]}
    swapped = ini | {"elements": ["Cl", "Na"]}
    values = [
        ("j0", "Na2Cl2", 0.1, "@a{K,}", ini, moved), ("j1", "Na2Cl2", 0.2, "SELF", ini, moved), ("j2", "Na(Cl)", 0.2, "none", ini, moved), ("j2", "NaCl", None, "@a{K,}", bad, s),
        ("j4", "NaCl", -1.0, "@a{K,}", ini, swapped), ("j5", "NaCl", float("inf"), "@a{K,}", s, s), ("j6", None, 0.15, "@a{K,}", None, s),
    ]
    rows = [(i, j, f, t, "PBE", b, "c", "n", "P1", x, y) for i, (j, f, t, b, x, y) in enumerate(values)]
    raw = spark.createDataFrame(rows, governance.RAW)
    out = {r.raw_index: r for r in governance.provenance(raw).collect()}
    flags = {i: set(r.quality_flag.split(";")) for i, r in out.items()}
    assert flags[0] == {"REPEATED_INITIAL_STRUCTURE", "REPEATED_FINAL_STRUCTURE"} and out[0].migrating_species == "Na" and out[0].migration_displacement_A == pytest.approx(0.8)
    assert flags[1] == flags[0] | {"DUPLICATE_TRANSITION_RECORD"}
    assert {"FORMULA_REDUCTION_FAILED", "MISSING_BIBTEX_CITATION_KEY", "DUPLICATE_TRANSITION_RECORD", "DUPLICATE_JID"} <= flags[2] and out[2].reduced_formula == "UNRESOLVED"
    assert out[3].quality_flag.startswith("MISSING_METADATA_target;INVALID_STRUCTURE_INI;BARRIER_NOT_NUMERIC;MIGRATING_SPECIES_UNRESOLVED") and out[3].structure_ini_hash == ""
    assert {"STRUCTURE_ELEMENT_ORDER_MISMATCH", "BARRIER_NEGATIVE"} <= flags[4] and {"BARRIER_NOT_FINITE", "MIGRATING_SPECIES_UNRESOLVED"} <= flags[5]
    assert "MISSING_METADATA_formula_structure_ini" in flags[6] and "MISSING_STRUCTURE_INI" in flags[6] and out[6].metadata_completeness == "0.800"
    assert out[0].duplicate_group_id.split(";")[0] == "initial_structure_" + out[0].structure_ini_hash[:16] and out[1].source_group == "SELF" and out[2].source_group == "unresolved"
    assert out[0].reduced_formula == "NaCl" and len(out[0].raw_record_sha256) == 64
    made = governance.run(raw, str(tmp_path))
    counts = made["audit"].first()
    assert (counts.records, counts.invalid_barrier_records, counts.formula_reduction_failure_records, counts.jids) == (7, 3, 2, 6)
    advice = {r.review_reason: r.review_guidance for r in made["review"].collect()}
    assert advice["REPEATED_INITIAL_STRUCTURE"] != advice["DUPLICATE_JID"] and advice["INVALID_STRUCTURE_INI"] == advice["MIGRATING_SPECIES_UNRESOLVED"]
    assert {r.value for r in made["counts"].where("kind = 'by_migrating_species'").collect()} == {"Na", "UNRESOLVED"}
    assert "records: 7" in "".join(r.value for r in spark.read.text(str(tmp_path / "audit_page")).collect())


def test_run_folder(spark, tmp_path):
    from percolith.cli import main

    (tmp_path / "p.json").write_text(json.dumps(graph()))
    assert main(["--save", str(tmp_path / "run"), "analyze", str(tmp_path / "p.json")]) == 0
    manifest = json.loads((tmp_path / "run" / "manifest.json").read_text())
    assert manifest["tables"]["ranked"]["rows"] == 2
    assert main(["validate"]) == 0
    assert sinks.digest(spark.range(3))["rows"] == 3
