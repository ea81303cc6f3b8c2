"""A periodic network derived from the standard tables, so that graph operators can run on them.

Graphs are regions, nodes their nations.  Every line item whose supplier and customer are of one region
is an observation of an edge from the supplier's nation to the customer's; keys modulo three give the
shift, and the mean quantity over all observations of an edge is its barrier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_regionkey").cast("string").alias("graph_id"), F.format_string("%02d", "n_nationkey").alias("node_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, edge_uid, node_i, node_j, a, b, c, barrier); small sides are left to the planner's size check."""
    line, order, customer, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    home = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    sellers = supplier.join(home, F.col("s_nationkey") == F.col("k")).select("s_suppkey", F.col("k").alias("ni"), F.col("r").alias("rs"))
    buyers = customer.join(home, F.col("c_nationkey") == F.col("k")).select("c_custkey", F.col("k").alias("nj"), F.col("r").alias("rc"))
    rows = line.join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).where("rs = rc")
    raw = rows.select(
        F.col("rs").cast("string").alias("graph_id"), F.format_string("%02d", "ni").alias("node_i"), F.format_string("%02d", "nj").alias("node_j"),
        *[(F.col(k) % 3 - 1).cast("int").alias(x) for k, x in (("l_orderkey", "a"), ("l_partkey", "b"), ("l_suppkey", "c"))], F.col("l_quantity").alias("q"),
    )
    kept = network.canonical(raw).where("not (node_i = node_j and a = 0 and b = 0 and c = 0)")
    barrier = F.floor(F.sum("q") * 200 / F.count("*")) / 10000.0
    out = kept.groupBy("graph_id", "node_i", "node_j", "a", "b", "c").agg(barrier.alias("barrier"))
    return out.withColumn("edge_uid", F.concat_ws("_", "node_i", "node_j", "a", "b", "c"))


#: The same network as DuckDB common table expressions: n (gid, node) and e (gid, ni, nj, a, b, c, bar).
NETWORK_SQL = """
n as (select cast(n_regionkey as varchar) gid, lpad(cast(n_nationkey as varchar), 2, '0') node from nation),
w as (select cast(sn.n_regionkey as varchar) gid, lpad(cast(sn.n_nationkey as varchar), 2, '0') ni, lpad(cast(cn.n_nationkey as varchar), 2, '0') nj,
        cast(l_orderkey % 3 - 1 as int) a, cast(l_partkey % 3 - 1 as int) b, cast(l_suppkey % 3 - 1 as int) c, l_quantity q
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
        join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey where sn.n_regionkey = cn.n_regionkey),
f as (select gid, q, ni > nj or (ni = nj and (a > 0 or (a = 0 and (b > 0 or (b = 0 and c > 0))))) as flip, ni, nj, a, b, c from w),
g as (select gid, q, if(flip, nj, ni) ni, if(flip, ni, nj) nj, if(flip, -a, a) a, if(flip, -b, b) b, if(flip, -c, c) c from f),
e as (select gid, ni, nj, a, b, c, floor(sum(q) * 200 / count(*)) / 10000.0::double bar from g
      where not (ni = nj and a = 0 and b = 0 and c = 0) group by all),
d as (select gid, ni, nj, a, b, c, bar from e union all select gid, nj, ni, -a, -b, -c, bar from e)
"""
