"""Queries that run the smaller operators over the standard tables, each with the rule written again in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import candidates, checks, network, selection, stats
from . import governance
from .queries import _SHIFTS, _SITES, _UID, _r, _sites, _with, query
from .tables import edges, nodes, table

# networks


@query(_with(f""", k as (select *, {_UID} uid from e where bar <= 0.16), dd as (select gid, uid, ni, nj from k union all select gid, uid, nj, ni from k),
 q(gid, cut, goal, n) as (select gid, uid, nj, ni from k where ni <> nj union select q.gid, q.cut, q.goal, dd.nj from q join dd on dd.gid = q.gid and dd.ni = q.n and dd.uid <> q.cut)
 select gid graph_id, cut edge_uid from q group by 1, 2, goal having not bool_or(n = goal)"""))
def graph_bridges(spark, sf):
    """Edges of a low network without which their ends are apart."""
    return network.bridges(nodes(spark, sf), edges(spark, sf).where("barrier <= 0.16"))


@query(_with(""", th as (select unnest([0.1, 0.12, 0.14, 0.16, 0.18, 0.2, 0.3])::double t),
 q(gid, t, s, n) as (select gid, t, node, node from n, th union select q.gid, q.t, q.s, d.nj from q join d on d.gid = q.gid and d.ni = q.n and d.bar <= q.t + 1e-12),
 l as (select gid, t, n, min(s) s from q group by all), m as (select gid, t, s, count(*) k from l group by all), shares as (select gid, t, max(k) / sum(k) fraction from m group by gid, t)
 select gid graph_id, min(t) filter (fraction >= 0.5) threshold from shares group by 1"""))
def graph_first_threshold(spark, sf):
    """The least threshold at which half of the nodes hang together."""
    return network.first_threshold(network.largest_fraction(nodes(spark, sf), edges(spark, sf), [0.1, 0.12, 0.14, 0.16, 0.18, 0.2, 0.3]))


# Shares of the largest component for every order of removal, 80 of them random by hash.
_RESPONSE = f""", k as (select *, {_UID} uid from e), deg as (select gid, node, count(*) c from (select gid, ni node from k union all select gid, nj from k) group by 1, 2),
 s as (select k.*, i.c + j.c score from k join deg i on i.gid = k.gid and i.node = ni join deg j on j.gid = k.gid and j.node = nj),
 o as (select 'ranked' strategy, 0 rep, gid, uid, ni, nj, row_number() over (partition by gid order by score desc, uid) r, count(*) over (partition by gid) m from s
  union all select 'random', z, gid, uid, ni, nj, row_number() over (partition by gid, z order by sha256('12|' || gid || '|' || z || '|' || uid)), count(*) over (partition by gid, z) from s, range(80) t(z)),
 fr as (select i / 10.0::double f from range(9) t(i)), left_ as (select strategy, rep, gid, f, ni, nj from o, fr where r > round_even(f * m, 0)),
 pairs as (select distinct strategy, rep, gid, f, ni, nj from (select * from left_ union all select strategy, rep, gid, f, nj, ni from left_)),
 q(strategy, rep, gid, f, s, n) as (select distinct strategy, rep, o.gid, f, node, node from (select distinct strategy, rep, gid from o) o join n using (gid), fr
  union select q.strategy, q.rep, q.gid, q.f, q.s, p.nj from q join pairs p on p.strategy = q.strategy and p.rep = q.rep and p.gid = q.gid and p.f = q.f and p.ni = q.n),
 c as (select strategy, rep, gid, f, s, count(*) k from q group by all), b as (select strategy, rep, gid, f, max(k) / (select count(*) from n where n.gid = c.gid)::double largest from c group by strategy, rep, gid, f)
"""


@query(_with(_RESPONSE + " select gid graph_id, strategy, f fraction, rep::int repeat, largest from b"))
def graph_removal_response(spark, sf):
    return network.removal_response(nodes(spark, sf), edges(spark, sf), [k / 10 for k in range(9)])


@query(_with(_RESPONSE + " select gid graph_id, strategy, f fraction, round(avg(largest), 9) largest from b group by 1, 2, 3"))
def graph_mean_response(spark, sf):
    """The mean share of the largest component, over all 80 random orders and for the ranked one."""
    out = network.mean_response(network.removal_response(nodes(spark, sf), edges(spark, sf), [k / 10 for k in range(9)]))
    return out.withColumn("largest", _r("largest", 9))


@query(f"with {_SITES}, {_SHIFTS}, p as (select i.k, a, b, c, sqrt((4 * (j.x - i.x + a)) ** 2 + (5 * (j.y - i.y + b)) ** 2 + (6 * (j.z - i.z + c)) ** 2) d from sites i join sites j on j.k = i.k + 1, cells) select k vec_id, arg_min(a, d)::int sa, arg_min(b, d)::int sb, arg_min(c, d)::int sc, round(min(d), 6) distance from p group by 1")
def minimum_images(spark, sf):
    """Nearest image from every site to the one with the next id."""
    s = _sites(spark, sf)
    pairs = s.select("vec_id", F.col("frac_coords").alias("p"), "lattice").join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("frac_coords").alias("q")), "vec_id")
    out = candidates.with_minimum_image(pairs, "p", "q", "lattice")
    return out.select("vec_id", *[F.col("image_shift")[i].alias(f"s{x}") for i, x in enumerate("abc")], _r("hop_distance").alias("distance"))


@query(f"with {_SITES} select i.g graph_id, i.id || '>' || j.id edge_uid from sites i join sites j on i.g = j.g and j.k % 5 = 0 and i.k <> j.k and i.k % 7 = 0 join sites t on t.g = i.g and t.k <> i.k and (t.k % 3 = j.k % 3) and t.k % 2 = 0 and sqrt((4 * ((t.x - j.x) - round_even(t.x - j.x, 0))) ** 2 + (5 * ((t.y - j.y) - round_even(t.y - j.y, 0))) ** 2 + (6 * ((t.z - j.z) - round_even(t.z - j.z, 0))) ** 2) < 0.5 group by 1, 2")
def occupied_ends(spark, sf):
    """Hops whose end another atom of the species is near to."""
    s = _sites(spark, sf)
    a = s.where("vec_id % 7 = 0").select("graph_id", F.col("node_id").alias("i"), F.col("vec_id").alias("moving_atom_index"), "lattice")
    b = s.where("vec_id % 5 = 0").select("graph_id", F.col("node_id").alias("j"), (F.col("vec_id") % 3).cast("string").alias("species"), F.col("vec_id").alias("_j"), F.col("frac_coords").alias("end_frac"))
    hops = a.join(b, "graph_id").where("moving_atom_index <> _j").withColumn("edge_uid", F.concat_ws(">", "i", "j"))
    atoms = s.where("vec_id % 2 = 0").select("graph_id", F.col("vec_id").alias("index"), (F.col("vec_id") % 3).cast("string").alias("element"), F.col("frac_coords").alias("frac"))
    return candidates.occupied_ends(hops, atoms, 0.5).select("graph_id", "edge_uid")


# checks


@query("select l_orderkey, l_linenumber from lineitem where not (l_quantity / 10 = floor(l_quantity / 10) and l_linenumber % 3 <> 0) ")
def check_shifts(spark, sf):
    x = table(spark, sf, "lineitem").withColumns({"a": F.col("l_quantity") / 10, "b": F.when(F.col("l_linenumber") % 3 != 0, F.lit(1.0)), "c": F.lit(-2)})
    return checks.bad_shifts(x).select("l_orderkey", "l_linenumber")


@query(_with(""", k as (select gid, ni, nj, a, b, c, case when bar < 0.3 then -bar when bar > 0.8 then 'inf'::double when bar > 0.7 then null else bar end bar, (ni = nj and bar < 0.5) z from e)
 select gid graph_id, ni node_i, nj node_j, a, b, c, case when z then 'zero self edge' when bar < 0 or isinf(bar) then 'barrier not finite or negative' else 'barrier missing' end reason from k where z or bar < 0 or isinf(bar) or bar is null"""))
def check_edges(spark, sf):
    e = edges(spark, sf)
    bar = F.when(F.col("barrier") < 0.3, -F.col("barrier")).when(F.col("barrier") > 0.8, F.lit(float("inf"))).when(F.col("barrier") > 0.7, None).otherwise(F.col("barrier"))
    zero = (F.col("node_i") == F.col("node_j")) & (F.col("barrier") < 0.5)
    moved = e.select("graph_id", "node_i", "node_j", *[F.col(x).alias(f"_{x}") for x in "abc"], *[F.when(zero, 0).otherwise(F.col(x)).alias(x) for x in "abc"], bar.alias("barrier"))
    return checks.bad_edges(moved, allow_missing=False).select("graph_id", "node_i", "node_j", *[F.col(f"_{x}").alias(x) for x in "abc"], "reason")


@query("select p_partkey from part where p_size % 3 = 0 or p_size % 5 = 0")
def check_blanks(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise(F.lit("  ")).alias("x"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("y"))
    return checks.blank_texts(p, ["x", "y"]).select("p_partkey")


@query("select vec_id from embeddings where vec_id % 4 in (0, 1, 2)")
def check_vectors(spark, sf):
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    x = F.when(F.col("vec_id") % 4 == 0, F.slice(v, 1, 2)).when(F.col("vec_id") % 4 == 1, F.concat(F.slice(v, 1, 2), F.array(F.lit(float("nan"))))).when(F.col("vec_id") % 4 == 3, v)
    return checks.bad_vectors(table(spark, sf, "embeddings").select("vec_id", x.alias("v")), "v").select("vec_id")


@query("select l_orderkey, l_linenumber from lineitem where not coalesce(l_discount between 0.02 and if(l_linenumber % 4 = 0, null, 0.06), false)")
def check_outside(spark, sf):
    x = table(spark, sf, "lineitem").withColumns({"lo": F.lit(0.02), "hi": F.when(F.col("l_linenumber") % 4 != 0, F.lit(0.06))})
    return checks.outside_interval(x, "l_discount", "lo", "hi").select("l_orderkey", "l_linenumber")


@query("with x as (select s_suppkey, s_acctbal v, s_suppkey % 4 k from supplier) select s_suppkey from x where not (k = 0 or k = 3)")
def check_convergence(spark, sf):
    v, k = F.col("s_acctbal"), F.col("s_suppkey") % 4
    x = table(spark, sf, "supplier").withColumns({f"eperc_{a}_{r}": F.when((k == 1) & (F.lit(r) == "r1") & (F.lit(a) == "b"), None).when((k == 2) & (F.lit(r) == "exact") & (F.lit(a) == "c"), v + 1e-6).when(k == 3, None).otherwise(v) for a in "abc" for r in ("r1", "r2", "exact")})
    return checks.not_converged(x).select("s_suppkey")


@query("select p_partkey, concat_ws(',', if(p_size > 40, 'size', null), if(p_retailprice > 1500, 'price', null)) failed from part where p_size > 40 or p_retailprice > 1500")
def check_rules(spark, sf):
    out = checks.failed_names(table(spark, sf, "part"), {"size": F.col("p_size") <= 40, "price": F.col("p_retailprice") <= 1500}, "p_partkey")
    return out.withColumn("failed", F.array_join("failed", ","))


@query("select vec_id from embeddings where vec_id % 6 in (1, 2, 3, 4)")
def check_structures(spark, sf):
    """Structures with a flat lattice, without atoms, with places that don't match or aren't finite."""
    k = F.col("vec_id") % 6
    flat = F.array(*[F.array(*[F.lit(float(i == j and not (i == 2))) for j in range(3)]) for i in range(3)])
    box = F.array(*[F.array(*[F.lit(4.0 * (i == j)) for j in range(3)]) for i in range(3)])
    place = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    s = F.struct(
        F.when(k == 1, flat).otherwise(box).alias("lattice_mat"), F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("Na"))).alias("elements"),
        F.when(k == 2, F.array().cast("array<array<double>>")).when(k == 3, F.array(place, place)).when(k == 4, F.array(F.array(F.lit(0.0), F.lit(float("inf")), F.lit(0.0)))).otherwise(F.array(place)).alias("coords"),
    )
    return checks.bad_structures(table(spark, sf, "embeddings").select("vec_id", s.alias("structure"))).select("vec_id")


# text and vectors


@query(r"select p_partkey, case p_size % 4 when 0 then p_size::double when 1 then p_retailprice end number, case p_size % 3 when 0 then p_size % 7 else -1 end middle, p_size % 3 = 0 has, coalesce(if(p_size % 3 = 0, p_name, null), '') filled, case p_brand when 'Brand#11' then 'eleven' else p_brand end brand from part")
def cell_functions(spark, sf):
    p, s = table(spark, sf, "part"), F.col("p_size")
    cell = F.when(s % 4 == 0, s.cast("string")).when(s % 4 == 1, F.concat(F.lit(" "), F.format_string("%.2f", "p_retailprice"))).when(s % 4 == 2, F.lit("nan")).otherwise(F.lit(" "))
    three = F.concat(F.lit("1, "), F.when(s % 3 == 0, s % 7).otherwise(F.lit(-1)).cast("string"), F.lit(" ,0"))
    name = F.when(s % 3 == 0, F.col("p_name"))
    return p.select("p_partkey", T.finite_or_null(cell).alias("number"), T.triple(three, "int")[1].alias("middle"), T.present(name, "string").alias("has"), T.text_number(name).alias("filled"), T.translated(F.col("p_brand"), {"Brand#11": "eleven"}).alias("brand"))


_BIB = "case p_size % 4 when 0 then ' self ' when 1 then '@Article { ' || replace(p_brand, '#', '') || ' , title = x}' when 2 then 'no entry' end"


@query(f"select p_partkey, case p_size % 4 when 0 then 'SELF' when 1 then replace(p_brand, '#', '') else '?' end source_group, p_size % 4 < 2 resolved from part")
def source_groups(spark, sf):
    b = F.expr(_BIB)
    return table(spark, sf, "part").select("p_partkey", T.source_group(b, F.lit("?")).alias("source_group"), T.source_resolved(b).alias("resolved"))


@query("with x as (select p_partkey, p_size % 6 + 1 a, p_size % 4 + 1 b, p_size % 9 = 0 bad from part), g as (select *, gcd(a, b) d from x) select p_partkey, if(bad, null, 'Na' || if(a = d, '', (a // d)::varchar) || 'Cl' || if(b = d, '', (b // d)::varchar)) reduced, if(bad, null, 'Na' || if(a = d, '', (a // d)::varchar) || 'Cl' || if(b = d, '', (b // d)::varchar) || '|Na') \"group\" from g")
def formula_functions(spark, sf):
    a, b = F.col("p_size") % 6 + 1, F.col("p_size") % 4 + 1
    formula = F.when(F.col("p_size") % 9 == 0, F.lit("Na(Cl)2")).otherwise(F.concat(F.lit("Na "), (a * 0.5).cast("string"), F.lit("Cl"), (b * 0.5).cast("string")))
    return table(spark, sf, "part").withColumn("f", formula).select("p_partkey", T.reduced_formula("f").alias("reduced"), T.group_key(F.col("f"), F.lit("Na")).alias("group"))


@query("""with x as (select n_nationkey, '{"a":[1.5,' || n_regionkey || '],"z":"' || n_name || '"}' j from nation) select n_nationkey, j canonical, sha256(j) hash from x""")
def json_functions(spark, sf):
    j = F.format_string('{ "z" : "%s", "a": [1.50, %d] }', "n_name", "n_regionkey")
    n = table(spark, sf, "nation").withColumn("j", j)
    return n.select("n_nationkey", T.canonical_json("j").alias("canonical"), T.json_sha256("j").alias("hash"))


_V = "x as (select vec_id, embedding[1]::double * 3 a, embedding[2]::double * 3 b, embedding[3]::double * 3 c, embedding[4]::double p, embedding[5]::double q, embedding[6]::double r from embeddings)"


@query(f"with {_V}, y as (select *, a - floor(a + 0.5) ha, (a - p) - round_even(a - p, 0) da, (b - q) - round_even(b - q, 0) db, (c - r) - round_even(c - r, 0) dc from x) select vec_id, round(a + p - b, 6) m, round(ha, 6) half, round(2 * a, 6) ca, round(sqrt((4 * da) ** 2 + (5 * db) ** 2 + (6 * dc) ** 2), 6) d, round(sqrt(least(1 + a * a, 25, 36)), 6) s, round(sqrt((a * a + 1e-4) / 77), 6) change, ((round_even((a - floor(a)) / 0.01, 0)::bigint % 100) + 100) % 100 quant from y")
def vector_arithmetic(spark, sf):
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 3)
    w = F.transform(F.slice("embedding", 4, 3), lambda x: x.cast("double"))
    x = table(spark, sf, "embeddings").select("vec_id", v.alias("v"), w.alias("w"))
    v, w = F.col("v"), F.col("w")

    def box(*d):
        return F.array(*[F.array(*[(x if i == j else F.lit(0.0)) for j in range(3)]) for i, x in enumerate(d)])

    lattice = box(F.lit(4.0), F.lit(5.0), F.lit(6.0))
    other = F.array(F.array(F.lit(4.0) + v[0], F.lit(0.01), F.lit(0.0)), lattice[1], lattice[2])
    small = box(F.sqrt(1 + v[0] * v[0]), F.lit(5.0), F.lit(6.0))
    return x.select(
        "vec_id", _r(V.add3(v, V.subtract3(w, V.negate3(V.negate3(F.array(v[1], v[1], v[1])))))[0]).alias("m"), _r(V.wrap_half_up(v)[0]).alias("half"), _r(V.to_cartesian(v, box(F.lit(2.0), F.lit(1.0), F.lit(1.0)))[0]).alias("ca"),
        _r(V.wrapped_distance(v, w, lattice)).alias("d"), _r(V.min_singular_value(small)).alias("s"), _r(V.lattice_change(lattice, other)).alias("change"), V.quantized(v[0], 0.01).alias("quant"),
    )


@query("with x as (select vec_id, list_sort(list_filter(list_transform(embedding[1:8], lambda v: v::double), lambda v: v > 1e-10)) d, list_transform(embedding[1:8], lambda v: v::double) g from embeddings) select vec_id, round(d[1], 9) \"first\", len(d) n, round(ln(1 + list_sum(list_transform(g, lambda v: exp(-v / 0.25)))), 6) crowding from x")
def distance_functions(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("d"))
    near = V.nearest_ordered(F.col("d"))
    return x.select("vec_id", _r(F.get(near, F.lit(0)), 9).alias("first"), F.size(near).cast("long").alias("n"), _r(V.log_crowding(F.col("d"), 0.25)).alias("crowding"))


# statistics and selection


@query("with m as (select o_orderpriority model, round(avg(o_totalprice), 2) macro_group_mae, round(stddev_pop(o_totalprice), 2) macro_group_mae_std, round(avg(o_totalprice), -3) mae, max(o_totalprice) rmse, min(o_totalprice) spearman from orders group by 1) select model, row_number() over (order by mae, rmse, spearman desc, model)::int rank from m")
def model_ranking(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"))
    m = o.agg(F.round(F.avg("o_totalprice"), 2).alias("macro_group_mae"), F.round(F.stddev_pop("o_totalprice"), 2).alias("macro_group_mae_std"), F.round(F.avg("o_totalprice"), -3).alias("mae"), F.max("o_totalprice").alias("rmse"), F.min("o_totalprice").alias("spearman"))
    return stats.rank_models(m).select("model", F.col("rank").cast("int").alias("rank"))


@query("with g as (select c_mktsegment s, c_nationkey k, count(*) records, min(c_custkey) f from customer group by 1, 2), q as (select s, sum(records) freq from g group by 1), b as (select s, min({'r': records, 'f': f, 'k': k}) b from g where records >= 5 group by 1) select s, b.k k, freq::bigint freq from b join q using (s) order by freq desc, s limit 4")
def group_selection(spark, sf):
    """The smallest eligible group of each species, species by falling frequency."""
    g = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("s"), F.col("c_nationkey").alias("k")).agg(F.count("*").alias("records"), F.min("c_custkey").alias("f"))
    return selection.select_groups(g.withColumn("eligible", F.col("records") >= 5), "s", "records", "f", "k", 4)


@query("select distinct c_nationkey, (dense_rank() over (order by c_nationkey) - 1)::int fold from customer where c_nationkey % 3 = 0")
def scoped_logo(spark, sf):
    return selection.scoped_leave_one_group_out(table(spark, sf, "customer").withColumn("scope", (F.col("c_nationkey") % 3 == 0).cast("int")), "c_nationkey", "scope")


@query("select c_nationkey::varchar what, count(distinct c_mktsegment) n, 'group' kind from customer group by 1 having count(distinct c_mktsegment) > 1")
def split_violations(spark, sf):
    return selection.split_violations(table(spark, sf, "customer"), "c_custkey", "c_nationkey", "c_mktsegment")


# governance: records made from the vectors, one in 5 a copy of the one before

_RAW = """b as (select vec_id i, (vec_id - (vec_id % 5 = 4)::int) s from embeddings), r as (select b.i, s, 'j' || (i % 450) jid,
  case s % 4 when 0 then 'Na2Cl2' when 1 then 'Na4Cl2' when 2 then 'Na(Cl)' end formula,
  case when i % 11 = 0 then null when i % 13 = 0 then -1.0 when i % 17 = 0 then 'inf'::double when i % 19 = 0 then 50.0 else (s % 10) / 10.0::double end target,
  case s % 3 when 0 then 'SELF' when 1 then '@a{K' || (s % 7) || ',}' else 'x' end bibtex, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from b join embeddings on vec_id = s),
 m as (select *, s % 8 = 0 noini, s % 8 = 1 bad, s % 8 = 2 swapped, s % 8 = 3 still, s % 8 = 4 tied from r),
 f as (select quantile_cont(target, 0.25) q1, quantile_cont(target, 0.75) q3 from r where target >= 0 and not isinf(target)),
 d as (select *, not noini and not bad sound, sqrt(((0.3 * 4)) ** 2) move from m),
 l as (select d.*, case when not sound then 'UNRESOLVED' when swapped then 'UNRESOLVED' when still then 'UNRESOLVED' when tied then 'UNRESOLVED' else 'Na' end species,
  count(*) over (partition by if(sound, printf('%d|%.17g|%.17g|%.17g', s % 8, x, y, z), i::varchar)) ini, count(*) over (partition by if(sound, printf('%d|%.17g|%.17g|%.17g', s % 8, x, y, z), i::varchar), target) same, count(*) over (partition by jid) jids from d),
 q as (select i, species, formula, concat_ws(';',
  if(formula is null or target is null or noini, 'MISSING_METADATA_' || concat_ws('_', if(formula is null, 'formula', null), if(target is null, 'target', null), if(noini, 'structure_ini', null)), null),
  if(noini, 'MISSING_STRUCTURE_INI', null), if(bad, 'INVALID_STRUCTURE_INI', null),
  case when target is null then 'BARRIER_NOT_NUMERIC' when isinf(target) then 'BARRIER_NOT_FINITE' when target < 0 then 'BARRIER_NEGATIVE' when target < q1 - 1.5 * (q3 - q1) or target > q3 + 1.5 * (q3 - q1) then 'BARRIER_IQR_OUTLIER' end,
  if(formula is null or formula = 'Na(Cl)', 'FORMULA_REDUCTION_FAILED', null),
  case when not sound then 'MIGRATING_SPECIES_UNRESOLVED' when swapped then 'STRUCTURE_ELEMENT_ORDER_MISMATCH;MIGRATING_SPECIES_UNRESOLVED' when still then 'MIGRATING_SPECIES_UNRESOLVED' when tied then 'MIGRATING_SPECIES_AMBIGUOUS' end,
  if(s % 3 = 2, 'MISSING_BIBTEX_CITATION_KEY', null), if(sound and ini > 1, 'REPEATED_INITIAL_STRUCTURE', null), if(fin > 1, 'REPEATED_FINAL_STRUCTURE', null),
  if(sound and same > 1, 'DUPLICATE_TRANSITION_RECORD', null), if(jids > 1, 'DUPLICATE_JID', null)) flag,
  case s % 3 when 0 then 'SELF' when 1 then 'K' || (s % 7) else 'unresolved' end source_group from (select *, count(*) over (partition by s) fin from l), f)"""


def _raw(spark, sf):
    e = table(spark, sf, "embeddings")
    base = e.select(F.col("vec_id").alias("i"), (F.col("vec_id") - (F.col("vec_id") % 5 == 4).cast("int")).alias("s"))
    v = e.select(F.col("vec_id").alias("s"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    i, s, v_ = F.col("i"), F.col("s"), F.col("v")
    box = F.array(*[F.array(*[F.lit(4.0 * (a == b)) for b in range(3)]) for a in range(3)])
    cl = F.transform(v_, lambda x: x * 0.5)

    def structure(elements, first, second):
        return F.struct(box.alias("lattice_mat"), elements.alias("elements"), F.array(first, second).alias("coords"), F.lit(False).alias("cartesian"))

    def shifted(x, by):
        return F.array(x[0] + by, x[1], x[2])

    names, back = F.array(F.lit("Na"), F.lit("Cl")), F.array(F.lit("Cl"), F.lit("Na"))
    sound = structure(names, v_, cl)
    ini = F.when(s % 8 == 0, None).when(s % 8 == 1, structure(F.array(F.lit("Na")), v_, cl)).otherwise(sound)
    fin = F.when(s % 8 == 2, structure(back, v_, cl)).when(s % 8 == 3, sound).when(s % 8 == 4, structure(names, shifted(v_, 0.3), shifted(cl, 0.3))).otherwise(structure(names, shifted(v_, 1.3), cl))
    target = F.when(i % 11 == 0, None).when(i % 13 == 0, -1.0).when(i % 17 == 0, float("inf")).when(i % 19 == 0, 50.0).otherwise((s % 10) / 10.0)
    return base.join(v, "s").select(
        i.alias("raw_index"), F.concat(F.lit("j"), i % 450).alias("jid"), F.when(s % 4 == 0, "Na2Cl2").when(s % 4 == 1, "Na4Cl2").when(s % 4 == 2, "Na(Cl)").alias("formula"), target.cast("double").alias("target"),
        F.lit("PBE").alias("XC"), F.when(s % 3 == 0, "SELF").when(s % 3 == 1, F.concat(F.lit("@a{K"), s % 7, F.lit(",}"))).otherwise("x").alias("bibtex"), F.lit("c").alias("crystal_class"), F.lit("n").alias("sys_name"), F.lit("P1").alias("space_group"),
        ini.alias("structure_ini"), fin.alias("structure_fin"),
    )


@query(f"with {_RAW} select i raw_index, case formula when 'Na2Cl2' then 'NaCl' when 'Na4Cl2' then 'Na2Cl' else 'UNRESOLVED' end reduced_formula, species migrating_species, source_group, if(flag = '', 'OK', flag) quality_flag from q")
def governance_rows(spark, sf):
    """Provenance of every record with all its flags."""
    return governance.provenance(_raw(spark, sf)).select("raw_index", "reduced_formula", "migrating_species", "source_group", "quality_flag")


def _any(*flags: str) -> str:
    return " or ".join(f"list_contains(string_split(flag, ';'), '{f}')" for f in flags)


@query(f"""with {_RAW} select count(*) records, count(*) filter ({_any("INVALID_STRUCTURE_INI", "MISSING_STRUCTURE_INI", "STRUCTURE_ELEMENT_ORDER_MISMATCH")}) missing_or_invalid_structure_records,
 count(*) filter ({_any("MIGRATING_SPECIES_UNRESOLVED", "MIGRATING_SPECIES_AMBIGUOUS")}) migrating_species_unresolved_records, count(*) filter ({_any("FORMULA_REDUCTION_FAILED")}) formula_reduction_failure_records,
 count(*) filter ({_any("BARRIER_NOT_NUMERIC", "BARRIER_NOT_FINITE", "BARRIER_NEGATIVE")}) invalid_barrier_records, count(*) filter ({_any("BARRIER_IQR_OUTLIER")}) barrier_iqr_outlier_records,
 count(*) filter ({_any("DUPLICATE_TRANSITION_RECORD")}) exact_duplicate_transition_records, count(*) filter (flag <> '') records_requiring_manual_confirmation, count(*) filter (flag like 'MISSING_METADATA%') metadata_incomplete_records from q""")
def audit_counts(spark, sf):
    out = governance.audit(governance.provenance(_raw(spark, sf)))
    return out.drop("jids", "repeated_initial_structure_records", "repeated_final_structure_records")


@query(f"""with {_RAW}, x as (select i, unnest(string_split(flag, ';')) flag from q where flag <> '') select i raw_index, flag review_reason,
 case when flag = 'BARRIER_IQR_OUTLIER' then 0 when flag like 'REPEATED_%' then 1 when flag like 'DUPLICATE_%' then 2 when flag like '%STRUCTURE%' or flag like '%MIGRATING%' then 3 else 4 end advice from x""")
def governance_review(spark, sf):
    """A row for every record and flag, with the place of its advice."""
    out = governance.review(governance.provenance(_raw(spark, sf)))
    place = F.array_position(F.array(*[F.lit(text) for _, text in governance.GUIDANCE]), F.col("review_guidance")) - 1
    return out.select("raw_index", "review_reason", place.cast("int").alias("advice"))


@query(f"with {_RAW}, c as (select 'by_XC' kind, 'PBE' \"value\", count(*) n from q union all select 'by_source_group', source_group, count(*) from q group by 2 union all select 'by_migrating_species', species, count(*) from q group by 2 union all select 'quality_flags', flag, count(*) from (select unnest(string_split(flag, ';')) flag from q where flag <> '') group by 2) select * from c")
def governance_counts(spark, sf):
    return governance.value_counts(governance.provenance(_raw(spark, sf)))
