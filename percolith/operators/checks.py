"""Validation as frames of violations: a check returns the rows that break a rule, and a guard raises if any does."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schemas import ACTIVE_EPS, MIN_LATTICE_DET


class CheckError(ValueError):
    """A rule of the data is broken; the message shows the first rows that break it."""


def require_none(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise CheckError(f"{what}: {[r.asDict() for r in found]}")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def whole(x: Column) -> Column:
    """A number without fraction: 1.0 passes, 1.5 doesn't."""
    return finite(x) & (x.cast("double") == F.floor(x.cast("double")))


def bad_shifts(edges: DataFrame) -> DataFrame:
    return edges.where(~(whole(F.col("a")) & whole(F.col("b")) & whole(F.col("c"))))


def bad_edges(edges: DataFrame, allow_missing: bool = True) -> DataFrame:
    """Zero self edges, and barriers that are negative or not finite (or missing)."""
    self_edge = (F.col("node_i") == F.col("node_j")) & (F.col("a") == 0) & (F.col("b") == 0) & (F.col("c") == 0)
    wrong = F.col("barrier").isNotNull() & (~finite(F.col("barrier")) | (F.col("barrier") < 0))
    reason = F.when(self_edge, "zero self edge").when(wrong, "barrier not finite or negative")
    if not allow_missing:
        reason = reason.when(F.col("barrier").isNull(), "barrier missing")
    return edges.withColumn("reason", reason).where("reason is not null")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def blank_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(F.greatest(*[F.coalesce(F.trim(c) == "", F.lit(True)) for c in columns]) if len(columns) > 1 else F.coalesce(F.trim(columns[0]) == "", F.lit(True)))


def unknown_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id) that edges name and the nodes lack."""
    ends = edges.select("graph_id", F.explode(F.array("node_i", "node_j")).alias("node_id")).distinct()
    return ends.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")


def validate_graphs(nodes: DataFrame, edges: DataFrame, allow_missing: bool = True) -> None:
    require_none(blank_texts(nodes, ["node_id"]), "blank node ids")
    require_none(duplicate_keys(nodes, ["graph_id", "node_id"]), "repeated nodes")
    require_none(duplicate_keys(edges, ["graph_id", "edge_uid"]), "repeated edges")
    require_none(unknown_endpoints(nodes, edges), "unknown endpoints")
    require_none(bad_edges(edges, allow_missing), "edges")


def bad_vectors(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.where(~F.coalesce((F.size(x) == 3) & F.forall(x, finite), F.lit(False)))


def bad_structures(df: DataFrame, column: str = "structure") -> DataFrame:
    """Structures whose lattice is flat or not finite, or whose atoms don't match their places."""
    s = F.col(column)
    m = s["lattice_mat"]
    shape = (F.size(m) == 3) & F.forall(m, lambda r: (F.size(r) == 3) & F.forall(r, finite))
    atoms = (F.size(s["elements"]) > 0) & (F.size(s["elements"]) == F.size(s["coords"])) & F.forall(s["coords"], lambda r: (F.size(r) == 3) & F.forall(r, finite))
    sound = F.when(F.coalesce(shape & atoms, F.lit(False)), V.volume(m) >= MIN_LATTICE_DET).otherwise(F.lit(False))
    return df.where(~sound)


def sound_structure(s: Column) -> Column:
    """Whether every atom has a name and a place, and places and lattice are finite numbers."""
    m = s["lattice_mat"]
    lattice = (F.size(m) == 3) & F.forall(m, lambda r: (F.size(r) == 3) & F.forall(r, finite))
    names = (F.size(s["elements"]) > 0) & F.forall(s["elements"], lambda e: F.coalesce(F.trim(e) != "", F.lit(False)))
    places = (F.size(s["elements"]) == F.size(s["coords"])) & F.forall(s["coords"], lambda r: (F.size(r) == 3) & F.forall(r, finite))
    return F.coalesce(lattice & names & places, F.lit(False))


def interval_violations(df: DataFrame) -> DataFrame:
    """Rows where lower90 <= lower80 <= point <= upper80 <= upper90 doesn't hold."""
    names = ["lower90", "lower80", "point", "upper80", "upper90"]
    ok = F.lit(True)
    for x, y in zip(names, names[1:], strict=False):
        ok = ok & (F.col(x) <= F.col(y))
    return df.where(~F.coalesce(ok, F.lit(False)))


def outside_interval(df: DataFrame, value: str, lower: str, upper: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(value).between(F.col(lower), F.col(upper)), F.lit(False)))


def not_converged(readouts: DataFrame, eps: float = ACTIVE_EPS) -> DataFrame:
    """Readouts whose radius-1, radius-2 and exact thresholds differ on some axis; two nulls agree."""
    def same(x: str, y: str) -> Column:
        a, b = F.col(x), F.col(y)
        return F.coalesce(F.abs(a - b) <= eps, a.isNull() & b.isNull())

    ok = F.lit(True)
    for axis in "abc":
        ok = ok & same(f"eperc_{axis}_r1", f"eperc_{axis}_r2") & same(f"eperc_{axis}_r2", f"eperc_{axis}_exact")
    return readouts.where(~ok)


def plain_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.casefold()).strip("_")


def leaking_names(columns: Iterable[str], patterns: Iterable[str] = (), names: Iterable[str] = (), allowed: Iterable[str] | None = None) -> list[str]:
    """Feature names that hold a forbidden pattern anywhere, hold a forbidden name as whole words (one or several),
    or aren't on the list of allowed ones.  All are compared in plain form."""
    parts, whole = [plain_name(p) for p in patterns], [f"_{plain_name(n)}_" for n in names]
    listed = None if allowed is None else set(allowed)
    return sorted({c for c in columns if any(p in plain_name(c) for p in parts) or any(n in f"_{plain_name(c)}_" for n in whole) or (listed is not None and c not in listed)})


def require_no_leakage(columns: Iterable[str], **rules) -> None:
    if found := leaking_names(columns, **rules):
        raise CheckError(f"features that leak the target: {found}")


def require_partition(columns: Sequence[str], blocks: dict[str, Sequence[str]]) -> None:
    """Blocks must cover the columns exactly, each column once."""
    listed = [c for b in blocks.values() for c in b]
    if sorted(listed) != sorted(columns) or len(set(listed)) != len(listed):
        raise CheckError(f"blocks don't partition the columns: {sorted(set(listed) ^ set(columns))}")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def failed_names(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, failed) with the names of the rules that a row breaks, for rows that break any."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, failed.alias("failed")).where(F.size("failed") > 0)


def one_graph_only(df: DataFrame) -> None:
    if df.select("graph_id").distinct().limit(2).count() > 1:
        raise CheckError("the tables hold more than one graph_id")
