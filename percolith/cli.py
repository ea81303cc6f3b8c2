"""Command line: analyze projects, structures and tables, and validate the engine.

    python -m percolith.cli analyze PROJECT.json [--skip-removal] [--save FOLDER]
    python -m percolith.cli structure FILE --species X --moving-atom-index N --end-frac a,b,c [--shift a,b,c]
    python -m percolith.cli graph-csv --nodes N.csv --edges E.csv [--barrier-column NAME]
    python -m percolith.cli examples --metrics M.csv [--comparison M2.csv]
    python -m percolith.cli paper --nodes N.csv --edges E.csv --metrics M.csv [--graph-id G] [--recompute]
    python -m percolith.cli validate [--nodes N.csv --edges E.csv --metrics M.csv]
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import kernel
from .plans.analyze import analyze
from .sources import readers, sinks

# Toy graphs, nodes, edges, rank and thresholds along the axes.
TOYS = [
    (2, [("e0", 0, 1, (0, 0, 0), 0.1)], 0, (None, None, None)),
    (1, [("ea", 0, 0, (1, 0, 0), 0.2)], 1, (0.2, None, None)),
    (1, [("ea", 0, 0, (1, 0, 0), 0.2), ("eb", 0, 0, (0, 1, 0), 0.3)], 2, (0.2, 0.3, None)),
    (1, [("ea", 0, 0, (1, 0, 0), 0.2), ("eb", 0, 0, (0, 1, 0), 0.3), ("ec", 0, 0, (0, 0, 1), 0.4)], 3, (0.2, 0.3, 0.4)),
]


def _triple(text: str, kind=float) -> list:
    out = [kind(x) for x in text.split(",")]
    if len(out) != 3:
        raise argparse.ArgumentTypeError("three numbers joined by commas are needed")
    return out


def validate() -> list[str]:
    """Names of the toy graphs that read out wrongly."""
    bad = []
    for k, (n, edges, rank, thresholds) in enumerate(TOYS):
        out = kernel.readout(n, edges)
        if out["winding_rank"] != rank or tuple(out[f"eperc_{x}"] for x in "abc") != thresholds or not out["converged"]:
            bad.append(f"{k}D")
    return bad


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="percolith")
    parser.add_argument("--language", default="en", choices=sorted(sinks.LABELS))
    parser.add_argument("--status-file")
    parser.add_argument("--save")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("analyze")
    one.add_argument("path")
    one.add_argument("--skip-removal", action="store_true")
    two = sub.add_parser("structure")
    two.add_argument("path")
    two.add_argument("--species", required=True)
    two.add_argument("--moving-atom-index", type=int, required=True)
    two.add_argument("--end-frac", type=_triple, required=True)
    two.add_argument("--shift", type=lambda x: _triple(x, int), default=[0, 0, 0])
    three = sub.add_parser("graph-csv")
    three.add_argument("--nodes", required=True)
    three.add_argument("--edges", required=True)
    three.add_argument("--barrier-column", default="barrier_eV")
    cases = {}
    for name in ("examples", "paper", "validate"):
        cases[name] = sub.add_parser(name)
        cases[name].add_argument("--metrics", required=name != "validate")
        if name != "examples":
            cases[name].add_argument("--nodes", required=name == "paper")
            cases[name].add_argument("--edges", required=name == "paper")
    cases["examples"].add_argument("--comparison")
    cases["paper"].add_argument("--graph-id")
    cases["paper"].add_argument("--recompute", action="store_true")
    args = parser.parse_args(argv)
    if args.status_file:
        _status(args.status_file, {"state": "running", "command": args.command})
    try:
        status = _run(args)
    except Exception as error:
        if args.status_file:
            _status(args.status_file, {"state": "failed", "command": args.command, "ok": False, "error": f"{type(error).__name__}: {error}"})
        raise
    if args.status_file:
        _status(args.status_file, {"state": "done" if status["ok"] else "failed", "command": args.command, "folder": args.save} | status)
    print(json.dumps({"ok": status["ok"]}))
    return 0 if status["ok"] else 1


def _status(path: str, what: dict) -> None:
    Path(path).write_text(json.dumps(what, default=str), encoding="utf-8")


def _cases(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """All cases of the tables, or the one asked for, each held against its saved figures."""
    nodes, edges = readers.case_tables(spark, args.nodes, args.edges)
    metrics = readers.case_metrics(spark, args.metrics)
    asked = [args.graph_id] if getattr(args, "graph_id", None) else [r.graph_id for r in metrics.select("graph_id").orderBy("graph_id").collect()]
    return [readers.load_case(nodes, edges, metrics, g, recompute=getattr(args, "recompute", True)) for g in asked]


def _run(args: argparse.Namespace) -> dict:
    if args.command == "validate":
        bad = validate()
        status = {"ok": not bad, "failed": bad}
        if args.nodes and args.edges and args.metrics:
            status["cases"] = len(_cases(SparkSession.builder.appName("percolith").getOrCreate(), args))
        return status
    spark = SparkSession.builder.appName("percolith").getOrCreate()
    if args.command == "examples":
        base = readers.case_metrics(spark, args.metrics)
        listed = readers.catalog(base, readers.case_metrics(spark, args.comparison), "base", "comparison") if args.comparison else base.withColumn("family", F.lit("base"))
        for row in listed.orderBy("family", "graph_id").toJSON().toLocalIterator():
            print(row)
        return {"ok": True}
    if args.command == "paper":
        for case in _cases(spark, args):
            print(json.dumps(case["metrics"], default=str))
        return {"ok": True}
    if args.command == "graph-csv":
        nodes, edges = readers.load_graph_csv(spark, args.nodes, args.edges, args.barrier_column)
    else:
        projects = readers.load_projects(spark, args.path) if args.command == "analyze" else readers.project_from_structure(readers.load_structures(spark, args.path), args.species, args.moving_atom_index, args.end_frac, args.shift)
        nodes, edges = readers.project_tables(projects)
    result = analyze(nodes, edges, with_removal=not getattr(args, "skip_removal", False))
    for row in result["readout"].drop("critical").toJSON().toLocalIterator():
        print(row)
    status = {"ok": True}
    if args.save:
        status["manifest"] = sinks.save_run(result, args.save, language=args.language)
    return status


if __name__ == "__main__":
    raise SystemExit(main())
