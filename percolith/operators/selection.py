"""Ranking, Pareto sorting, diversity, splits: operators that choose rows."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import AXES
from . import stats


def rank_candidates(edges: DataFrame, critical: DataFrame | None = None, removal: DataFrame | None = None, exclude_labeled: bool = True) -> DataFrame:
    """Two lexicographic rankings of each graph's edges, both descending with the uid as last key.

    ``edges`` has graph_id, edge_uid, barrier, and optionally spread, is_labeled and ood.  Labelled edges
    count in the distributions but aren't ranked.  exploit: critical, not out of domain, low barrier, effect of
    removal, spread.  explore: critical, out of domain, effect, spread, low barrier.
    """
    for name, kind in (("spread", "double"), ("is_labeled", "boolean"), ("ood", "boolean")):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast(kind))
    edges = edges.withColumns({"spread": F.coalesce("spread", F.lit(0.0)), "ood": F.coalesce("ood", F.lit(False)).cast("int")})
    # a graph is one partition of these windows, and is bounded
    here = Window.partitionBy("graph_id")
    up_to = "count(*) over (partition by graph_id order by {} range between unbounded preceding and 1e-12D following)"
    total = F.count("*").over(here)
    rows = edges.withColumns({"low": 1.0 - F.expr(up_to.format("barrier")) / total, "wide": F.expr(up_to.format("spread")) / total, "_top": F.max("barrier").over(here)})
    if critical is not None:
        rows = rows.join(critical.select("graph_id", "edge_uid", F.lit(1).alias("critical"), F.col("directions").alias("critical_directions")), ["graph_id", "edge_uid"], "left")
    else:
        rows = rows.withColumns({"critical": F.lit(0), "critical_directions": F.array().cast("array<string>")})
    rows = rows.withColumns({"critical": F.coalesce("critical", F.lit(0)), "critical_directions": F.coalesce("critical_directions", F.array().cast("array<string>"))})
    if removal is not None:
        deltas = F.greatest(*[F.coalesce(f"delta_eperc_{x}", F.lit(0.0)) for x in AXES])
        lost = F.greatest(*[F.col(f"lost_{x}") for x in AXES])
        effect = removal.select("graph_id", "edge_uid", deltas.alias("_d"), lost.alias("_lost"))
        rows = rows.join(effect, ["graph_id", "edge_uid"], "left")
        rows = rows.withColumn("max_delta", F.when(F.col("_lost"), F.greatest(F.col("_d"), F.col("_top") + 1.0)).otherwise(F.col("_d"))).drop("_d", "_lost")
    else:
        rows = rows.withColumn("max_delta", F.lit(None).cast("double"))
    if exclude_labeled:
        rows = rows.where(~F.coalesce("is_labeled", F.lit(False)))
    delta = F.coalesce("max_delta", F.lit(0.0))
    exploit = here.orderBy(F.desc("critical"), F.asc("ood"), F.desc("low"), delta.desc(), F.desc("wide"), F.desc("edge_uid"))
    explore = here.orderBy(F.desc("critical"), F.desc("ood"), delta.desc(), F.desc("wide"), F.desc("low"), F.desc("edge_uid"))
    return rows.withColumns({"exploit_rank": F.row_number().over(exploit).cast("int"), "explore_rank": F.row_number().over(explore).cast("int")}).drop("_top")


def _signed(columns: dict[str, str]) -> list[tuple[str, str]]:
    if bad := [d for d in columns.values() if d not in ("min", "max")]:
        raise ValueError(f"directions are min or max, not {bad}")
    return [(c, "-" if d == "max" else "") for c, d in columns.items()]


def skyline(df: DataFrame, key: str, objectives: dict[str, str]) -> DataFrame:
    """Rows that no other row dominates: at least as good in all objectives and better in one.

    Each partition first drops what its own rows dominate, keeping a running front in Python; only local
    fronts are gathered, by halving the number of partitions, and the last front is small.  Rows are
    never paired across the whole table.
    """
    import pandas as pd

    names = list(objectives)
    signs = [(-1.0 if s else 1.0) for _, s in _signed(objectives)]
    schema = df.schema

    def local(tables):
        import numpy as np

        kept, front = [], np.zeros((0, len(names)))
        for t in tables:
            x = t[names].to_numpy(float) * signs
            for v in front[:64]:  # most rows fall to a few members of the front, all at once
                out = (v <= x).all(axis=1) & (v < x).any(axis=1)
                x, t = x[~out], t[~out]
            whole = pd.concat([*kept, t]) if kept else t
            both = np.concatenate([front, x])
            order = np.lexsort(both.T[::-1])
            alive: list[int] = []
            best = np.zeros((0, len(names)))
            for i in order:
                v = both[i]
                if not ((best <= v).all(axis=1) & (best < v).any(axis=1)).any():
                    alive.append(i)
                    best = np.concatenate([best, v[None]])
            alive.sort()
            kept, front = [whole.iloc[alive]], both[alive]
        yield from kept

    sound = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in names))
    out, parts = sound.mapInPandas(local, schema), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = (parts + 7) // 8
        out = out.repartition(parts).mapInPandas(local, schema)
    return out


#: Rows of the ranges that one task passes over.
RANGE = 1 << 20


def pareto_layers(df: DataFrame, key: str, objectives: dict[str, str]) -> DataFrame:
    """(key, layer) of every row: the front it is in when fronts are peeled until no row is left, from 1.

    A row's layer is one more than the longest chain that dominates it.  In one or two objectives that takes
    one ordered pass, whose state is the least last objective of each layer so far: rows are ranged by their
    objectives, range after range hands its state on, and then all ranges number their rows at once.  In more
    objectives fronts are peeled.  Rows that lack an objective (null or NaN) have a null layer.
    """
    names = [f"o{i}" for i in range(len(objectives))]
    values = [(-F.col(c).cast("double") if s else F.col(c).cast("double")) + 0.0 for c, s in _signed(objectives)]
    rows = df.select(F.col(key).alias("k"), *[v.alias(n) for v, n in zip(values, names, strict=True)])
    sound = F.expr(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
    out = _chained(rows.where(sound), names) if len(names) < 3 else _peeled(rows.where(sound), names)
    lacking = rows.where(~sound).select("k", F.lit(None).cast("int").alias("layer"))
    return out.select("k", "layer").unionByName(lacking).withColumnRenamed("k", key)


def _pass(tails: list[float], last: tuple, x, y) -> tuple:
    """Layers of rows in order of x, then y; ``tails`` is the least y of each layer, ``last`` the row before."""
    from bisect import bisect_right

    layers = []
    for at in zip(x.tolist(), y.tolist(), strict=True):
        if at != last[:2]:
            k = bisect_right(tails, at[1])
            tails[k : k + 1] = [at[1]]
            last = (*at, k + 1)
        layers.append(last[2])
    return layers, last


def _chained(rows: DataFrame, names: list[str]) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    from ..shared import stored

    spark = rows.sparkSession
    rows = rows.select("k", F.col(names[0]).alias("x"), F.col(names[-1]).alias("y"))
    # the key takes part, so that many equal rows fall into several ranges
    ranged = rows.repartitionByRange(rows.count() // RANGE + 1, "x", "y", F.xxhash64("k"))
    table = stored(ranged.withColumn("part", F.spark_partition_id()))
    runs: list[list[int]] = []
    held = 0
    for part, n in sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()):
        if runs and held + n <= RANGE:
            runs[-1][1], held = part, held + n
        else:
            runs.append([part, part])
            held = n
    starts: list[tuple] = [(np.zeros(0), ())]
    for first, final in runs[:-1]:
        before = starts[-1]

        def state(batches, before=before):
            tails, last = before[0].tolist(), before[1]
            for b in batches:
                _, last = _pass(tails, last, b.column("x").to_numpy(), b.column("y").to_numpy())
            yield pa.RecordBatch.from_pydict({"tails": [np.array(tails).tobytes()], "x": [last[0]], "y": [last[1]], "layer": pa.array([last[2]], pa.int32())})

        ordered = table.where(F.col("part").between(first, final)).coalesce(1).sortWithinPartitions("x", "y", F.xxhash64("k"))
        r = ordered.select("x", "y").mapInArrow(state, "tails binary, x double, y double, layer int").first()
        starts.append((np.frombuffer(bytes(r["tails"])), (r["x"], r["y"], r["layer"])))
    shared = spark.sparkContext.broadcast(starts)
    number = F.lit(0)
    for first, _ in runs[1:]:
        number = number + (F.col("part") >= first).cast("int")

    def layers(batches):
        now, tails, last = -1, [], ()
        for b in batches:
            run, x, y = (b.column(c).to_numpy() for c in ("run", "x", "y"))
            found, cuts = [], [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    if run[i] != now:
                        now = int(run[i])
                        tails, last = shared.value[now][0].tolist(), shared.value[now][1]
                    more, last = _pass(tails, last, x[i:j], y[i:j])
                    found += more
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(found, pa.int32())], names=["k", "layer"])

    dealt = table.select("k", "x", "y", number.alias("run")).repartition(max(1, len(runs)), "run").sortWithinPartitions("run", "x", "y")
    return dealt.mapInArrow(layers, f"k {rows.schema['k'].dataType.simpleString()}, layer int")


def _peeled(rows: DataFrame, names: list[str]) -> DataFrame:
    """Every front is appended to one folder; only the rows left are kept beside it."""
    import uuid

    from ..shared import delete, shared_folder

    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("append").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    left, layer = put(rows, "left0"), 0
    out = put(rows.limit(0).withColumn("layer", F.lit(0)), "fronts")
    while left.limit(1).count():
        layer += 1
        front = put(skyline(left, "k", dict.fromkeys(names, "min")), f"front{layer}")
        out = put(front.withColumn("layer", F.lit(layer)), "fronts")
        # by values, as rows equal to one of the front are in it too; keys need not be distinct
        left = put(left.join(front.select(*names).distinct(), names, "left_anti").select(*rows.columns), f"left{layer}")
        for old in (f"left{layer - 1}", f"front{layer}"):
            delete(spark, f"{folder}/{old}")
    return out


def farthest_first(df: DataFrame, key: str, features: Sequence[str], n: int, strata: str | None = None) -> DataFrame:
    """(key, place) of ``n`` rows chosen to be far apart: the least key first, then always the row farthest
    from those chosen, ties to the lesser key; with strata, these take turns in order.

    Only the ``n`` chosen rows reach the driver, one a round; a round is one aggregate over the table.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), (F.col(strata).cast("string") if strata else F.lit("")).alias("s"))
    names = [r.s for r in rows.select("s").distinct().orderBy("s").collect()]
    chosen: list[tuple[str, list[float]]] = []
    gone: set[str] = set()
    turn = 0
    while len(chosen) < n and len(gone) < len(names):
        name = names[turn % len(names)]
        turn += 1
        if name in gone:
            continue
        left = rows.where((F.col("s") == name) & (~F.col("k").isin([c[0] for c in chosen]) if chosen else F.lit(True)))
        near = F.lit(0.0)
        if chosen:
            near = F.least(*[_square(x) for _, x in chosen], F.lit(float("inf")))
        best = left.select("k", "x", near.alias("d")).orderBy(F.desc("d"), "k").limit(1).collect()
        if best:
            chosen.append((best[0].k, best[0].x))
        else:
            gone.add(name)
    return df.sparkSession.createDataFrame([(k, i + 1) for i, (k, _) in enumerate(chosen)], f"{key} string, place int")


def _square(x: Sequence[float]):
    return F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in x]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def top_n(df: DataFrame, column: str, n: int, key: str, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(column) if largest else F.asc(column), key).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], column: str, n: int, key: str, largest: bool = True) -> DataFrame:
    """The ``n`` rows of each group with the greatest (or least) value, ties to the lesser key; groups are cut before they are shuffled."""
    order = Window.partitionBy(*by).orderBy(F.desc(column) if largest else F.asc(column), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of at most n rows, in the order of a seeded hash."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def hash_split(df: DataFrame, group: str, calibration: float = 0.2, seed: int = 20260807, context: str = "", levels: Sequence[float] = (0.8, 0.9)) -> DataFrame:
    """(group, part) with the outer training groups of ``df`` in calibration or proper_train, never looking at a target.

    Groups go in the order of the sha256 of the canonical JSON of seed, context, column and group.  The share is
    rounded up, and raised to the least number of groups that the levels need; what leaves no group to train on is refused.
    """
    if not 0.0 < calibration < 1.0:
        raise ValueError("the calibration share must lie between 0 and 1")
    text = F.col(group).cast("string")
    payload = F.to_json(F.struct(F.lit(seed).alias("base_seed"), F.lit(context).alias("context"), text.alias("group"), F.lit(group).alias("group_column")))
    groups = df.select(group).distinct().withColumn("h", T.json_sha256(payload))
    n = groups.count()
    least = max([stats.min_calibration_groups(x) for x in levels], default=1)
    count = max(math.ceil(calibration * n), least)
    if n < 2 or count >= n:
        raise ValueError(f"{n} groups leave none to train on beside {count} for calibration")
    first = groups.orderBy("h", text).limit(count).select(group, F.lit("calibration").alias("part"))
    return groups.select(group).join(first, group, "left").select(group, F.coalesce("part", F.lit("proper_train")).alias("part"))


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups from the largest, each to the fold with fewest rows so far.

    Group sizes, not rows, reach the driver; ties go to the lesser group and the lower fold.
    """
    sizes = sorted(((r["n"], r[group]) for r in stats.count_by(df, group).collect()), key=lambda x: (-x[0], x[1]))
    if len(sizes) < k:
        raise ValueError(f"{len(sizes)} groups cannot fill {k} folds")
    load = [0] * k
    out = []
    for n, g in sizes:
        fold = min(range(k), key=lambda f: (load[f], f))
        load[fold] += n
        out.append((g, fold))
    kind = dict(df.dtypes)[group]
    return df.sparkSession.createDataFrame(out, f"{group} {kind}, fold int")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """(group, fold) with one fold a group, numbered in order; groups, each of which is a model to train, are few."""
    names = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    if len(names) < 2:
        raise ValueError("leaving one group out takes two")
    return df.sparkSession.createDataFrame([(g, k) for k, g in enumerate(names)], f"{group} {dict(df.dtypes)[group]}, fold int")


def scoped_leave_one_group_out(df: DataFrame, group: str, scope: str) -> DataFrame:
    """(group, fold) of the groups that have a row in scope; a fold's test rows are its group's in scope, and its
    training rows those of all other groups, in scope or not."""
    return leave_one_group_out(df.where(F.col(scope).cast("int") == 1), group)


def split_violations(assigned: DataFrame, key: str, group: str, part: str) -> DataFrame:
    """Keys placed other than once, and groups in more than one part."""
    keys = assigned.groupBy(F.col(key).cast("string").alias("what")).agg(F.count("*").alias("n")).where("n <> 1").withColumn("kind", F.lit("key"))
    groups = assigned.groupBy(F.col(group).cast("string").alias("what")).agg(F.countDistinct(part).alias("n")).where("n > 1").withColumn("kind", F.lit("group"))
    return keys.unionByName(groups)


def split_hash(assigned: DataFrame, key: str, part: str, train: str = "train", test: str = "test") -> str:
    """sha256 of the canonical JSON of a split's sorted training and test record ids.

    The ids are sorted by Spark and streamed to the driver, which holds one partition of them at a time.
    """
    digest = hashlib.sha256()
    for k, (name, value) in enumerate((("test_record_ids", test), ("train_record_ids", train))):
        digest.update(f'{"{" if not k else ","}"{name}":['.encode())
        ids = assigned.where(F.col(part) == value).select(F.col(key).cast("string").alias("k")).orderBy("k")
        for i, row in enumerate(ids.toLocalIterator()):
            digest.update(("," if i else "").encode() + json.dumps(row.k, ensure_ascii=False).encode())
        digest.update(b"]")
    digest.update(b"}")
    return digest.hexdigest()


def group_distances(train: DataFrame, queries: DataFrame, group: str, features: Sequence[str], key: str, block: int = 2048) -> DataFrame:
    """(key, group, distance): each query's least distance to every other training group.

    Queries, a stated set, are taken in blocks and broadcast; a block meets the training rows once, and
    rows are reduced to one a query and group within each partition before anything is shuffled.
    """
    import numpy as np
    import pandas as pd

    spark = train.sparkSession
    kinds = dict(queries.dtypes), dict(train.dtypes)
    columns = list(dict.fromkeys([key, group, *features] if group in queries.columns else [key, *features]))
    total = queries.count()
    parts, out = -(-total // block) or 1, None
    for b in range(parts):
        mine = queries.select(*columns).where(F.pmod(F.xxhash64(key), F.lit(parts)) == b).toPandas()
        shared = spark.sparkContext.broadcast((mine[key].tolist(), mine[group].tolist() if group in mine else [None] * len(mine), mine[list(features)].to_numpy(float)))

        def near(tables, shared=shared):
            keys, own, q = shared.value
            best: dict = {}
            for t in tables:
                x, g = t[list(features)].to_numpy(float), t[group].to_numpy()
                for name in pd.unique(g):
                    y = x[g == name]
                    d = np.sqrt(np.maximum(((q[:, None, :] - y[None, :, :]) ** 2).sum(axis=2), 0).min(axis=1)) if len(q) else np.zeros(0)
                    best[name] = np.minimum(best[name], d) if name in best else d
            for name, d in best.items():
                ok = [i for i in range(len(keys)) if own[i] != name]
                yield pd.DataFrame({key: [keys[i] for i in ok], group: [name] * len(ok), "distance": d[ok]})

        found = train.select(group, *features).mapInPandas(near, f"{key} {kinds[0][key]}, {group} {kinds[1][group]}, distance double")
        found = found.groupBy(key, group).agg(F.min("distance").alias("distance"))
        out = found if out is None else out.unionByName(found)
    return out


def kth_group_distance(distances: DataFrame, key: str, group: str, k: int) -> DataFrame:
    """(key, distance) to the k-th nearest group; a row with fewer than k other groups fails the query."""
    near = distances.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("distance", group))).alias("d"))
    few = F.raise_error(F.concat(F.lit(f"fewer than {k} other groups for "), F.col(key).cast("string"))).cast("double")
    return near.select(key, F.when(F.size("d") < k, few).otherwise(F.get("d", F.lit(k - 1)).getField("distance")).alias("distance"))


def select_groups(groups: DataFrame, species: str, size: str, first: str, key: str, n: int) -> DataFrame:
    """Species by falling frequency, the smallest eligible group of each, the first ``n``."""
    freq = groups.groupBy(species).agg(F.sum("records").alias("freq"))
    best = groups.where("eligible").groupBy(species).agg(F.min(F.struct(size, first, key)).alias("b"))
    return best.join(freq, species).orderBy(F.desc("freq"), species).limit(n).select(species, f"b.{key}", "freq")
