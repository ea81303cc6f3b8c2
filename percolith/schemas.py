"""Schemas of the records that the engine reads and writes, and its tolerances."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


#: An edge counts as active up to this much above the threshold; thresholds this close are equal.
ACTIVE_EPS = 1e-12
#: Least determinant of a lattice; distance of a start atom; distance within which an end site is taken.
MIN_LATTICE_DET, START_TOLERANCE, OCCUPIED_TOLERANCE = 1e-8, 0.01, 0.01
AXES = ("a", "b", "c")

STRUCTURE = _struct(
    lattice_mat=ArrayType(ArrayType(DoubleType())),
    elements=ArrayType(StringType()),
    coords=ArrayType(ArrayType(DoubleType())),
    cartesian=BooleanType(),
)

PROJECT_NODE = _struct(id=StringType(), frac_coords=ArrayType(DoubleType()))
PROJECT_EDGE = _struct(
    edge_uid=StringType(),
    node_i=StringType(),
    node_j=StringType(),
    image_shift=ArrayType(DoubleType()),
    barrier_eV=DoubleType(),
    barrier_source=StringType(),
    moving_atom_index=IntegerType(),
    is_labeled=BooleanType(),
)
PROJECT = _struct(
    schema_version=IntegerType(),
    kind=StringType(),
    name=StringType(),
    graph_id=StringType(),
    formula=StringType(),
    migrating_species=StringType(),
    structure=STRUCTURE,
    nodes=ArrayType(PROJECT_NODE),
    edges=ArrayType(PROJECT_EDGE),
)

#: One node of many graphs, one edge of many graphs.
NODES = _struct(graph_id=StringType(), node_id=StringType(), frac_coords=ArrayType(DoubleType()))
EDGES = _struct(graph_id=StringType(), edge_uid=StringType(), node_i=StringType(), node_j=StringType(), a=IntegerType(), b=IntegerType(), c=IntegerType(), barrier=DoubleType())

CRITICAL = ArrayType(_struct(edge_uid=StringType(), directions=ArrayType(StringType()), rank_critical=BooleanType()))
SUPERCELL = _struct(cells=LongType(), node_images=LongType(), edge_images=LongType())
READOUT = StructType(
    [
        StructField("graph_id", StringType()),
        StructField("scenario", StringType()),
        StructField("removed_uid", StringType()),
        StructField("status", StringType()),
        StructField("barrier_coverage", DoubleType()),
        *[StructField(f"eperc_{x}{suffix}", DoubleType()) for suffix in ("", "_r1", "_r2", "_exact") for x in AXES],
        StructField("converged", BooleanType()),
        StructField("winding_rank", IntegerType()),
        StructField("union_rank", IntegerType()),
        StructField("redundancy", LongType()),
        StructField("n_components", LongType()),
        StructField("n_nodes", LongType()),
        StructField("n_edges", LongType()),
        StructField("critical", CRITICAL),
        StructField("missing_barrier_edge_uids", ArrayType(StringType())),
        StructField("periodic_dimensionality", StringType()),
        StructField("winding_vectors", ArrayType(ArrayType(IntegerType()))),
        StructField("supercell_r1", SUPERCELL),
        StructField("supercell_r2", SUPERCELL),
    ]
)
