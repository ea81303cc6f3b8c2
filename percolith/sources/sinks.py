"""Writers: JSON, CSV with sidecars, a run folder with a manifest, and a short report."""

from __future__ import annotations

import hashlib
import html
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = 200
LABELS = {"en": {"title": "Network report", "edges": "Ranked edges"}, "zh": {"title": "网络报告", "edges": "排序的边"}}


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a table can be written as CSV."""
    nested = [c for c, k in df.dtypes if k.startswith(("array", "struct", "map"))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV part files with header; ``single`` puts a small result into one file."""
    out = flat(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames one after another with the columns in order of first appearance."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def logical_schema(df: DataFrame) -> list[dict]:
    """Name, logical type and nullability of every field."""
    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number"}
    out = []
    for f in df.schema.fields:
        k = f.dataType.simpleString()
        kind = "array" if k.startswith("array") else "object" if k.startswith(("struct", "map")) else "number" if k.startswith("decimal") else kinds.get(k, "integer" if "int" in k else k)
        out.append({"name": f.name, "type": kind, "nullable": f.nullable})
    return out


def digest(df: DataFrame) -> dict:
    """Rows and an order-free checksum of a table, in one aggregate."""
    row = df.select(F.xxhash64(*[F.col(c).cast("string") if k != "map" else F.to_json(c) for c, k in flat(df).dtypes]).alias("h")) if df.columns else None
    found = row.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return {"rows": found.n, "checksum": hashlib.sha256(f"{found.s}|{found.x}".encode()).hexdigest()}


def write_csv_artifacts(df: DataFrame, path: str) -> dict:
    """CSV, its schema, and a checksum with audit counts beside it, all through Spark's writers."""
    table = flat(df)
    write_csv(table, f"{path}/data")
    spark = df.sparkSession
    notes = {"schema": logical_schema(df), "audit": digest(table)}
    for name, value in notes.items():
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    return notes


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text as one file of a folder, wherever Spark can write."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_file(spark: SparkSession, text: str, path: str) -> None:
    """One text as a plain file through Hadoop's file systems, so the path may be remote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def graph_json(nodes: DataFrame, edges: DataFrame, readout: DataFrame) -> DataFrame:
    """(graph_id, json): metadata, nodes, edges and readout of every graph as one text; graphs are bounded."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in nodes.columns if c != "graph_id"]))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in edges.columns if c != "graph_id"]))).alias("edges"))
    r = readout.select("graph_id", F.struct(*[c for c in readout.columns if c != "graph_id"]).alias("readout"))
    return n.join(e, "graph_id", "left").join(r, "graph_id", "left").select("graph_id", F.to_json(F.struct("graph_id", "nodes", "edges", "readout")).alias("json"))


def summary(nodes: DataFrame, edges: DataFrame, readout: DataFrame) -> DataFrame:
    """One row a graph with counts and figures."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("node_count"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("edge_count"), F.min("barrier").alias("lowest"), F.max("barrier").alias("highest"))
    return n.join(e, "graph_id", "left").join(readout.withColumn("critical_count", F.size("critical")).drop("critical", "n_nodes", "n_edges"), "graph_id", "left")


def report_html(ranked: DataFrame, readout: DataFrame, language: str = "en") -> str:
    """A page with the readouts and the first edges of the ranking."""
    words = LABELS.get(language, LABELS["en"])

    def table(rows) -> str:
        if not rows:
            return ""
        head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0].asDict())
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    first = flat(ranked).orderBy("graph_id", "exploit_rank").limit(REPORT_ROWS).collect()
    return f"<!doctype html><meta charset='utf-8'><title>{words['title']}</title><h1>{words['title']}</h1>{table(flat(readout).limit(REPORT_ROWS).collect())}<h2>{words['edges']}</h2>{table(first)}"


def save_run(result: dict[str, DataFrame], folder: str, inputs: dict[str, str] | None = None, language: str = "en") -> dict:
    """A run folder: tables as Parquet and CSV, the report, and a manifest with checksums."""
    manifest: dict = {"created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "inputs": inputs or {}, "tables": {}}
    for name, df in result.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        stored = df.sparkSession.read.parquet(f"{folder}/{name}.parquet")
        write_csv(stored, f"{folder}/{name}.csv", single=True)
        manifest["tables"][name] = digest(flat(stored)) | {"schema": logical_schema(stored)}
    spark = next(iter(result.values())).sparkSession
    if {"ranked", "readout"} <= set(result):
        page = report_html(result["ranked"], result["readout"], language)
        write_file(spark, page, f"{folder}/report.html")
        manifest["report_sha256"] = hashlib.sha256(page.encode()).hexdigest()
    write_file(spark, json.dumps(manifest, indent=2, ensure_ascii=False), f"{folder}/manifest.json")
    return manifest
