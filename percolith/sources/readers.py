"""Readers: projects, node and edge tables, crystal structures, catalogues, and files under a hash gate."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import checks
from ..operators.checks import CheckError, require_none
from ..schemas import AXES, OCCUPIED_TOLERANCE, PROJECT, START_TOLERANCE

KINDS = ("path_project", "periodic_graph")


def load_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project documents under an explicit schema, checked for version and kind."""
    df = spark.read.schema(PROJECT).option("multiLine", True).json(path)
    bad = df.where(~F.coalesce((F.col("schema_version") == 1) & F.col("kind").isin(*KINDS), F.lit(False))).select("schema_version", "kind")
    require_none(bad, "projects of an unknown version or kind")
    return df


def project_tables(projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the projects; blank ids are rejected and missing uids numbered."""
    nodes = projects.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", F.trim("n.id").alias("node_id"), F.col("n.frac_coords").alias("frac_coords"))
    require_none(checks.bad_vectors(nodes, "frac_coords"), "node coordinates")
    raw = projects.select("graph_id", "kind", "structure", "migrating_species", F.posexplode("edges").alias("k", "e"))
    s = F.col("e.image_shift")
    edges = raw.select(
        "graph_id", F.coalesce(F.nullif(F.trim("e.edge_uid"), F.lit("")), T.edge_uid(F.col("k") + 1)).alias("edge_uid"),
        F.trim("e.node_i").alias("node_i"), F.trim("e.node_j").alias("node_j"), *[s[i].alias(x) for i, x in enumerate(AXES)],
        F.col("e.barrier_eV").alias("barrier"), F.col("e.moving_atom_index").alias("moving_atom_index"), F.coalesce("e.is_labeled", F.lit(False)).alias("is_labeled"), "kind", "structure", "migrating_species",
    )
    require_none(checks.bad_shifts(edges), "image shifts")
    edges = edges.withColumns({x: F.col(x).cast("int") for x in AXES})
    checks.validate_graphs(nodes, edges)
    _check_paths(nodes, edges.where("kind = 'path_project'"))
    return nodes, edges.drop("kind", "structure", "migrating_species")


def _check_paths(nodes: DataFrame, edges: DataFrame) -> None:
    """The mover must be of the species and at the start; no atom of the species may sit at the end."""
    require_none(checks.bad_structures(edges).select("graph_id", "edge_uid"), "structures")
    ends = with_endpoints(edges, nodes)
    s = F.col("structure")
    k = F.col("moving_atom_index")
    mover = F.element_at(s["elements"], k + 1) == F.col("migrating_species")
    there = V.wrapped_distance(F.element_at(s["coords"], k + 1), F.col("start_frac"), s["lattice_mat"]) <= START_TOLERANCE
    sound = F.when((k >= 0) & (k < F.size(s["elements"])), mover & there).otherwise(False)
    require_none(ends.where(k.isNotNull() & ~sound).select("graph_id", "edge_uid"), "moving atoms that aren't at the start")
    atoms = F.filter(F.arrays_zip(s["elements"].alias("e"), s["coords"].alias("x"), F.sequence(F.lit(0), F.size(s["elements"]) - 1).alias("i")), lambda a: (a["e"] == F.col("migrating_species")) & ~F.coalesce(a["i"] == k, F.lit(False)))
    taken = F.exists(atoms, lambda a: V.wrapped_distance(a["x"], F.col("end_frac"), s["lattice_mat"]) < OCCUPIED_TOLERANCE)
    require_none(ends.where(taken).select("graph_id", "edge_uid"), "end sites that are occupied")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends; every endpoint must be known."""
    require_none(checks.unknown_endpoints(nodes, edges), "unknown endpoints")
    ends = nodes.select("graph_id", "node_id", "frac_coords")
    out = edges.join(ends.withColumnsRenamed({"node_id": "node_i", "frac_coords": "start_frac"}), ["graph_id", "node_i"])
    return out.join(ends.withColumnsRenamed({"node_id": "node_j", "frac_coords": "end_frac"}), ["graph_id", "node_j"])


def load_graph_csv(spark: SparkSession, nodes_path: str, edges_path: str, barrier_column: str = "barrier_eV") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of one graph; a byte-order mark is dropped and the barrier column is chosen."""
    nodes, edges = read_csv(spark, nodes_path), read_csv(spark, edges_path)
    for df, need in ((nodes, ["graph_id", "node_id", "frac_coords"]), (edges, ["graph_id", "edge_uid", "node_i", "node_j", "image_shift_a", "image_shift_b", "image_shift_c", barrier_column])):
        if lost := checks.missing_columns(df, need):
            raise CheckError(f"columns are missing: {lost}")
    checks.one_graph_only(nodes.select("graph_id").union(edges.select("graph_id")))
    nodes = nodes.withColumn("frac_coords", F.from_json("frac_coords", "array<double>"))
    require_none(checks.bad_vectors(nodes, "frac_coords").select("node_id"), "node coordinates")
    text = F.nullif(F.trim(barrier_column), F.lit(""))
    edges = edges.select("graph_id", "edge_uid", "node_i", "node_j", *[F.expr(f"try_cast(image_shift_{x} as double)").alias(x) for x in AXES], text.alias("_b"))
    require_none(checks.bad_shifts(edges), "image shifts")
    require_none(edges.where(F.col("_b").isNotNull() & F.col("_b").try_cast("double").isNull()), "barriers that aren't numbers")
    edges = edges.select("graph_id", "edge_uid", "node_i", "node_j", *[F.col(x).cast("int").alias(x) for x in AXES], F.col("_b").try_cast("double").alias("barrier"))
    checks.validate_graphs(nodes, edges)
    return nodes, edges


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """CSV with a header, all columns text; only the asked ones are read.  ``keep_empty`` keeps blank cells as texts."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    if keep_empty:
        reader = reader.option("nullValue", "\x00").option("emptyValue", "")
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV, or an empty frame of that schema where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def first_existing(spark: SparkSession, paths: Sequence[str], rows: int = 2000) -> DataFrame:
    """A preview of the first path that exists."""
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return read_csv(spark, path).limit(rows)
    raise CheckError(f"none of these exists: {list(paths)}")


def exactly_one(df: DataFrame, what: str) -> dict:
    found = df.limit(2).collect()
    if len(found) != 1:
        raise CheckError(f"{what}: {'none' if not found else 'more than one'}")
    return found[0].asDict()


def catalog(base: DataFrame, other: DataFrame, base_family: str, other_family: str) -> DataFrame:
    """One list of cases from two metric tables, by name, each with its family."""
    return base.withColumn("family", F.lit(base_family)).unionByName(other.withColumn("family", F.lit(other_family)), allowMissingColumns=True)


def case_tables(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of many saved cases, as ``load_graph_csv`` reads those of one."""
    n = read_csv(spark, nodes).withColumn("frac_coords", F.from_json("frac_coords", "array<double>"))
    e = read_csv(spark, edges)
    barrier = next((c for c in ("barrier_eV", "predicted_barrier_eV") if c in e.columns), None)
    if barrier is None:
        raise CheckError("the edges have no barrier column")
    e = e.select("graph_id", "edge_uid", "node_i", "node_j", *[F.col(f"image_shift_{x}").cast("int").alias(x) for x in AXES], T.finite_or_null(F.col(barrier)).alias("barrier"))
    return n.select("graph_id", "node_id", "frac_coords"), e


def case_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Saved figures of cases, a row a graph: counts and thresholds in the engine's names, blanks as nulls."""
    df = read_csv(spark, path)
    counts = {"n_nodes": "node_count", "n_edges": "edge_count"}
    out = [F.col("graph_id")] + [F.col(was).cast("int").alias(now) for was, now in counts.items() if was in df.columns]
    return df.select(*out, *[T.finite_or_null(F.col(f"Eperc_{x}")).alias(f"eperc_{x}") for x in AXES if f"Eperc_{x}" in df.columns])


def load_case(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, graph_id: str, recompute: bool = False, tolerance: float = 1e-8) -> dict:
    """Nodes, edges and figures of one case; with ``recompute`` its thresholds must come out again."""
    from ..operators import network

    row = exactly_one(metrics.where(F.col("graph_id") == graph_id), f"case {graph_id}")
    n, e = nodes.where(F.col("graph_id") == graph_id), edges.where(F.col("graph_id") == graph_id)
    for df, name in ((n, "node_count"), (e, "edge_count")):
        if row.get(name) is not None and df.count() != int(row[name]):
            raise CheckError(f"case {graph_id}: {name} differs")
    if recompute:
        again = network.readout(n, e).first()
        for x in AXES:
            was, now = row.get(f"eperc_{x}"), again[f"eperc_{x}"]
            if (was is None) != (now is None) or was is not None and abs(float(was) - now) > tolerance:
                raise CheckError(f"case {graph_id}: threshold along {x} is {now}, not {was}")
    return {"nodes": n, "edges": e, "metrics": row}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, suffix) of every file below a folder; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.select("path", "length", F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def gated_json(spark: SparkSession, path: str, sha256: str, schema) -> DataFrame:
    """JSON that is read only if the file has the stated digest."""
    found = exactly_one(file_sha256(spark, path), path)["sha256"]
    if found != sha256:
        raise CheckError(f"{path} has digest {found}, not {sha256}")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def element_table(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """Element properties with blanks as nulls."""
    df = read_csv(spark, path)
    return df.select("symbol", *[T.finite_or_null(F.col(c)).alias(c) for c in properties])


def normalise_elements(df: DataFrame, symbol: str, numbers: dict[str, str], metal: str | None = None) -> DataFrame:
    """A library's element table in our columns: the first number of each cell, and the metal mark."""
    out = [F.col(symbol).alias("symbol"), *[T.first_number(F.col(src)).alias(name) for name, src in numbers.items()]]
    return df.select(*out, *([T.is_metal(F.col(metal)).alias("is_metal")] if metal else []))


def bibtex_entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, entry) of a BibTeX file; an entry runs to the next line that starts with @."""
    df = spark.read.text(path, wholetext=True)
    parts = df.select(F.posexplode(F.expr(r"filter(split(value, '(?m)(?=^@)'), x -> startswith(trim(x), '@'))")).alias("place", "entry"))
    return parts.select("place", F.regexp_extract("entry", T.BIBTEX_KEY, 1).alias("key"), F.lower(F.regexp_extract("entry", r"@(\w+)", 1)).alias("kind"), F.trim("entry").alias("entry"))


def curated(entries: DataFrame, keep: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries on the keep list, overridden by later ones of the same key, and the keys that are missing."""
    ranked = entries.select("key", "entry", "place", F.lit(0).alias("late")).unionByName(overrides.select("key", "entry", F.lit(0).alias("place"), F.lit(1).alias("late")))
    best = ranked.groupBy("key").agg(F.max(F.struct("late", "place", "entry")).alias("b")).select("key", F.col("b.entry").alias("entry"))
    return best.join(keep.select("key"), "key", "left_semi"), keep.select("key").join(best, "key", "left_anti")


def lattice_from_cell(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """Lattice rows from lengths and angles in degrees, a along x and b in the xy plane."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    return [[a, 0.0, 0.0], [b * cg, b * sg, 0.0], [cx, cy, math.sqrt(max(0.0, c * c - cx * cx - cy * cy))]]


def parse_cif(text: str) -> dict:
    """Cell and atoms of a CIF in the trivial space group; coordinates aren't wrapped."""
    def number(x: str) -> float:
        return float(re.sub(r"\(\d+\)$", "", x))

    values = dict(re.findall(r"(?m)^(_\S+)[ \t]+(\S.*?)\s*$", text))
    cell = [number(values[f"_cell_{x}"]) for x in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")]
    group = " ".join(v for k, v in values.items() if "space_group" in k and "name" in k).replace("'", "").replace('"', "").replace(" ", "")
    if group and group != "P1":
        raise CheckError(f"only structures in P1 are read, not {group}")
    for loop in re.split(r"(?m)^loop_\s*$", text)[1:]:
        lines = [x.strip() for x in loop.strip().splitlines() if x.strip()]
        names = list(_header(lines))
        if "_atom_site_fract_x" not in names:
            continue
        rows = []
        for line in lines[len(names) :]:
            if line.startswith(("_", "loop_", "#", "data_")):
                break
            rows.append(line.split())
        at = {n: k for k, n in enumerate(names)}
        label = at.get("_atom_site_type_symbol", at.get("_atom_site_label"))
        elements = [re.match(r"[A-Z][a-z]?", r[label])[0] for r in rows]
        coords = [[number(r[at[f"_atom_site_fract_{x}"]]) for x in "xyz"] for r in rows]
        return {"lattice_mat": lattice_from_cell(*cell), "elements": elements, "coords": coords, "cartesian": False}
    raise CheckError("the CIF has no atoms with fractional coordinates")


def _header(lines: list[str]) -> Iterable[str]:
    for line in lines:
        if not line.startswith("_"):
            return
        yield line.split()[0]


def parse_poscar(text: str) -> dict:
    """Lattice and atoms of a POSCAR; Cartesian places become fractional, unwrapped."""
    lines = text.splitlines()
    scale = float(lines[1])
    lattice = np.array([[float(x) for x in line.split()[:3]] for line in lines[2:5]])
    lattice = lattice * scale if scale > 0 else lattice * (-scale / abs(np.linalg.det(lattice))) ** (1 / 3)
    symbols, counts = lines[5].split(), [int(x) for x in lines[6].split()]
    at = 7
    if lines[at].strip()[:1] in "sS":
        at += 1
    cartesian = lines[at].strip()[:1] in "cCkK"
    n = sum(counts)
    coords = np.array([[float(x) for x in line.split()[:3]] for line in lines[at + 1 : at + 1 + n]])
    if cartesian:
        coords = coords * (scale if scale > 0 else 1.0) @ np.linalg.inv(lattice)
    return {"lattice_mat": lattice.tolist(), "elements": [s for s, k in zip(symbols, counts, strict=True) for _ in range(k)], "coords": coords.tolist(), "cartesian": False}


def load_structures(spark: SparkSession, path: str) -> DataFrame:
    """(path, structure) of CIF and POSCAR files, parsed on the executors."""
    from ..schemas import STRUCTURE

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))

    def run(tables: Iterable[pd.DataFrame]):
        for t in tables:
            parsed = [parse_cif(x) if "_cell_length_a" in x else parse_poscar(x) for x in t["text"]]
            yield pd.DataFrame({"path": t["path"], "structure": parsed})

    out = files.mapInPandas(run, f"path string, structure {STRUCTURE.simpleString()}")
    return out


def project_from_structure(structures: DataFrame, species: str, atom: int, end: Sequence[float], shift: Sequence[int]) -> DataFrame:
    """One-edge path projects: the atom's place and the end are the nodes."""
    start = F.element_at(F.col("structure.coords"), atom + 1)
    end_ = F.array(*[F.lit(float(x)) for x in end])
    nodes = F.array(F.struct(F.lit("start").alias("id"), start.alias("frac_coords")), F.struct(F.lit("end").alias("id"), end_.alias("frac_coords")))
    edge = F.struct(
        F.lit("path_0001").alias("edge_uid"), F.lit("start").alias("node_i"), F.lit("end").alias("node_j"), F.array(*[F.lit(float(x)) for x in shift]).alias("image_shift"),
        F.lit(None).cast("double").alias("barrier_eV"), F.lit(None).cast("string").alias("barrier_source"), F.lit(atom).alias("moving_atom_index"), F.lit(False).alias("is_labeled"),
    )
    counted = F.array_distinct(F.col("structure.elements"))
    formula = F.array_join(F.transform(counted, lambda e: F.concat(e, F.size(F.filter(F.col("structure.elements"), lambda x: x == e)).cast("string"))), "")
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return structures.select(F.lit(1).alias("schema_version"), F.lit("path_project").alias("kind"), name.alias("name"), name.alias("graph_id"), formula.alias("formula"), F.lit(species).alias("migrating_species"), "structure", nodes.alias("nodes"), F.array(edge).alias("edges"))
