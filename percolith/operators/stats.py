"""Aggregates, quantiles, metrics and calibration as Catalyst expressions.

Everything here is a bounded number of aggregates with map-side partials, plus joins on their keys.  No
window spans the whole table: global ranks come from counts per distinct value (``ecdf``), so no task
sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Conformal rank tolerance, and tolerance of the reference percentile.
RANK_EPS, PERCENTILE_EPS = 1e-12, 1e-15
METRICS = ("mae", "rmse", "median_ae", "r2", "spearman", "kendall", "macro_group_mae", "macro_group_mae_std")


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def flag_counts(df: DataFrame, column: str = "quality_flag") -> DataFrame:
    """Rows per flag of a ``;``-joined list; OK is no flag."""
    return review_rows(df, [], column).groupBy("flag").agg(F.count("*").alias("n"))


def review_rows(df: DataFrame, keys: Sequence[str], column: str = "quality_flag") -> DataFrame:
    """One row per (record, flag)."""
    return df.select(*keys, F.explode(F.split(column, ";")).alias("flag")).where("flag <> 'OK' and flag <> ''")


def duplicate_groups(df: DataFrame, keys: Sequence[str], size: str = "group_size") -> DataFrame:
    """Rows with how many share their keys; counts are aggregated first, so a frequent key is no hot task."""
    counts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = df.join(counts, same, "left")
    return joined.select(*df.columns, F.coalesce("_n", F.lit(1)).cast("long").alias(size))


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles by linear interpolation, as columns q0, q1, .."""
    return df.groupBy(*by).agg(*[F.percentile(column, F.lit(p)).alias(f"q{k}") for k, p in enumerate(probabilities)])


def fences(df: DataFrame, column: str, k: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and fences over finite values that aren't negative: (q1, q3, lower, upper)."""
    x = F.col(column)
    sound = df.where(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    out = quantiles(sound, column, (0.25, 0.75), by)
    spread = F.col("q1") - F.col("q0")
    return out.select(*by, F.col("q0").alias("q1"), F.col("q1").alias("q3"), (F.col("q0") - k * spread).alias("lower"), (F.col("q1") + k * spread).alias("upper"))


def value_code(column: str, lower: Column, upper: Column) -> Column:
    x = F.col(column)
    return F.when(x.isNull() | F.isnan(x), "MISSING").when((x < 0) | (F.abs(x) == float("inf")), "INVALID").when(x < lower, "LOW").when(x > upper, "HIGH").otherwise("OK")


def cutoffs(df: DataFrame, group: str, column: str, probability: float, at_least: int) -> DataFrame:
    """(group, n, cutoff, source): a group's quantile, or the overall one where the group is small."""
    own = df.groupBy(group).agg(F.count("*").alias("n"), F.percentile(column, F.lit(probability)).alias("own"))
    overall = df.agg(F.percentile(column, F.lit(probability)).alias("overall"))
    both = own.crossJoin(F.broadcast(overall))  # one row
    enough = F.col("n") >= at_least
    return both.select(group, "n", F.when(enough, F.col("own")).otherwise(F.col("overall")).alias("cutoff"), F.when(enough, "group").otherwise("global").alias("source"))


def weighted_stats(value: str, weight: str) -> list[Column]:
    """mean, std (population), min, max and the share of weight that has a value, as aggregates."""
    x, w = F.col(value), F.col(weight)
    has = x.isNotNull() & ~F.isnan(x)
    total, sw = F.sum(F.when(has, w)), F.sum(F.when(has, w * x))
    mean = sw / total
    var = F.sum(F.when(has, w * x * x)) / total - mean * mean
    return [mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("std"), F.min(F.when(has, x)).alias("min"), F.max(F.when(has, x)).alias("max"), (F.coalesce(total, F.lit(0.0)) / F.sum(w)).alias("coverage")]


def composition(df: DataFrame, key: str, symbol: str) -> DataFrame:
    """(key, n, kinds, entropy, max_fraction, min_fraction) of the symbols in each group."""
    counts = df.groupBy(key, symbol).agg(F.count("*").alias("c"))
    whole = counts.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log("c")).alias("cl"), F.max("c").alias("hi"), F.min("c").alias("lo"))
    n = F.col("n").cast("double")
    return whole.select(key, "n", "kinds", (F.log(n) - F.col("cl") / n).alias("entropy"), (F.col("hi") / n).alias("max_fraction"), (F.col("lo") / n).alias("min_fraction"))


def composition_fractions(df: DataFrame, key: str, symbol: str, symbols: Sequence[str]) -> DataFrame:
    """One column a symbol of the fixed list: its share in the group."""
    return df.groupBy(key).agg(*[(F.count_if(F.col(symbol) == s) / F.count("*")).alias(f"fraction_{s}") for s in symbols])


def ecdf(df: DataFrame, column: str, eps: float = 1e-12, name: str = "ecdf") -> DataFrame:
    """Each distinct value with the share of rows at or below it (plus eps); rows are counted per value first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    return weighted_percentile(counts, column, "_c", counts.select(column), column, eps).withColumnRenamed("percentile", name)


def cumulative(counts: DataFrame, order: str, amount: str, name: str, parts: int | None = None) -> DataFrame:
    """Running sum of ``amount`` in order of a numeric column whose values are distinct.

    Rows fall into ranges between approximate quantiles; ranges are summed in parallel, and the totals of
    the ranges before, at most ``parts`` numbers, are added.  No task sees all rows.
    """
    parts = parts or min(64, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = counts.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5], 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    kind = dict(counts.dtypes)[order]
    part = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    ranged = counts.withColumn("_part", part)
    within = ranged.withColumn("_in", F.sum(amount).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_part")


def average_ranks(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the mean rank of their value (ties share it), over all rows or within groups."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_c"))
    window = Window.partitionBy(*by).orderBy(column) if by else None
    if by:
        ranked = counts.withColumn("_b", F.sum("_c").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranked = cumulative(counts, column, "_c", "_b")
    ranked = ranked.select(*by, column, (F.col("_b") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.join(ranked, [*by, column])


def percent_rank_average(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean rank over the number of rows."""
    ranked = average_ranks(df, column, "_r", by)
    total = df.groupBy(*by).agg(F.count(column).alias("_n")) if by else df.agg(F.count(column).alias("_n"))
    joined = ranked.join(total, list(by)) if by else ranked.crossJoin(F.broadcast(total))
    return joined.withColumn(name, F.col("_r") / F.col("_n")).drop("_r", "_n")


def min_max(df: DataFrame, column: str, name: str, by: Sequence[str], invert: bool = False) -> DataFrame:
    """Column scaled to 0..1 within each group; a constant group is 0 (1 if inverted)."""
    ends = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = F.when(F.col("_hi") - F.col("_lo") < 1e-12, F.lit(0.0)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(ends, list(by)).withColumn(name, 1.0 - x if invert else x).drop("_lo", "_hi")


def overlap(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts of the four cases of two flags."""
    a, b = F.coalesce(F.col(x), F.lit(False)), F.coalesce(F.col(y), F.lit(False))
    return df.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) over equal widths; the last bin includes its upper end."""
    at = F.least(F.lit(bins), F.expr(f"width_bucket({column}, {lo!r}D, {hi!r}D, {bins})"))
    return df.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def weighted_quantile(df: DataFrame, column: str, weight: str, probability: float) -> DataFrame:
    """Least value whose cumulated weight reaches the probability; no interpolation."""
    sums = df.groupBy(column).agg(F.sum(weight).alias("_w"))
    run = cumulative(sums, column, "_w", "_run")
    total = df.agg(F.sum(weight).alias("_total"))
    return run.crossJoin(F.broadcast(total)).where(F.col("_run") / F.col("_total") >= probability - 1e-12).agg(F.min(column).alias("quantile"))


def weighted_percentile(reference: DataFrame, column: str, weight: str, queries: DataFrame, query: str, eps: float = PERCENTILE_EPS) -> DataFrame:
    """Queries with the share of reference weight at or below them (plus eps).

    References and queries are put in one order and run over together, instead of a range join.
    """
    total = reference.agg(F.sum(weight).alias("_total"))
    ref = reference.groupBy(F.col(column).alias("_x")).agg(F.sum(weight).alias("_w")).withColumn("_q", F.lit(0))
    ask = queries.select(F.col(query).alias("_v")).distinct().select((F.col("_v") + eps).alias("_x"), F.lit(0.0).alias("_w"), F.lit(1).alias("_q"), "_v")
    both = ref.withColumn("_v", F.lit(None).cast("double")).select("_x", "_w", "_q", "_v").unionByName(ask)
    at = both.groupBy("_x").agg(F.sum("_w").alias("_w"), F.collect_set("_v").alias("_vs"))
    run = cumulative(at, "_x", "_w", "_run")
    found = run.select(F.explode("_vs").alias(query), "_run").crossJoin(F.broadcast(total)).select(query, (F.col("_run") / F.col("_total")).alias("percentile"))
    return queries.join(found, query)


def regression_metrics(df: DataFrame, truth: str, predicted: str, group: str, with_kendall: bool = True) -> DataFrame:
    """One row: mae, rmse, median_ae, r2, spearman, kendall (if asked), macro_group_mae and its population deviation."""
    e = F.abs(F.col(truth) - F.col(predicted))
    basic = df.agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(e).alias("median_ae"),
        (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(truth))).alias("r2"),
    )
    groups = df.groupBy(group).agg(F.avg(e).alias("m")).agg(F.avg("m").alias("macro_group_mae"), F.stddev_pop("m").alias("macro_group_mae_std"))
    ranked = average_ranks(average_ranks(df.select(truth, predicted), truth, "_rt"), predicted, "_rp")
    spearman = ranked.agg(F.corr("_rt", "_rp").alias("spearman"))
    out = basic.crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(spearman))
    return out.crossJoin(F.broadcast(kendall(df, truth, predicted))) if with_kendall else out


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b.  Discordant pairs are inversions: counted per block of a radix over y's rank, in
    rounds of one aggregate each, so no pairs are made."""
    counts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    n = F.sum("c")

    def ties(by: list[str]) -> DataFrame:
        return counts.groupBy(*by).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("t"))

    # dense ranks, then concordance by merging: every level of a binary trie over y's rank adds pairs that split there
    ranks = [counts.groupBy(k).agg(F.count("*").alias("one")).select(k, F.lit(1).alias("one")) for k in ("x", "y")]
    dense = [cumulative(r, k, "one", f"{k}r").select(k, F.col(f"{k}r").cast("long").alias(f"{k}r")) for r, k in zip(ranks, ("x", "y"), strict=True)]
    coded = counts.join(dense[0], "x").join(dense[1], "y").select("xr", "yr", "c")
    top = coded.agg(F.max("yr")).first()[0] or 0
    parts = []
    for level in range(int(top).bit_length()):
        block = coded.select(F.shiftright("yr", level + 1).alias("b"), F.shiftright("yr", level).bitwiseAND(F.lit(1)).alias("bit"), "xr", "c")
        cells = block.groupBy("b", "xr").agg(F.sum(F.when(F.col("bit") == 0, F.col("c")).otherwise(0)).alias("lo"), F.sum(F.when(F.col("bit") == 1, F.col("c")).otherwise(0)).alias("hi"))
        w = Window.partitionBy("b").orderBy("xr").rowsBetween(Window.unboundedPreceding, -1)
        run = cells.select("lo", "hi", F.coalesce(F.sum("lo").over(w), F.lit(0)).alias("lo_before"), F.coalesce(F.sum("hi").over(w), F.lit(0)).alias("hi_before"))
        parts.append(run.agg(F.sum(F.col("hi") * F.col("lo_before")).alias("con"), F.sum(F.col("lo") * F.col("hi_before")).alias("dis")))
    both = counts.agg(n.alias("n"))
    tx, ty = ties(["x"]).select(F.col("t").alias("tx")), ties(["y"]).select(F.col("t").alias("ty"))
    out = both.crossJoin(F.broadcast(tx)).crossJoin(F.broadcast(ty))
    if not parts:
        return out.select(F.lit(None).cast("double").alias("kendall"))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    pairs = pairs.agg(F.sum("con").alias("con"), F.sum("dis").alias("dis"))
    half = F.col("n") * (F.col("n") - 1) / 2
    down = F.sqrt((half - F.col("tx")) * (half - F.col("ty")))
    return out.crossJoin(F.broadcast(pairs)).select(F.when(down > 0, (F.col("con") - F.col("dis")) / down).alias("kendall"))


def rank_models(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Rank by mae, rmse, then spearman falling (a missing one last), then id; models are few."""
    order = Window.orderBy("mae", "rmse", F.col("spearman").desc_nulls_last(), model)
    return metrics.withColumn("rank", F.row_number().over(order))


def min_calibration_groups(level: float) -> int:
    m = 1
    while -int(-((m + 1) * level - RANK_EPS) // 1) > m:
        m += 1
    return m


def conformal_fit(df: DataFrame, group: str, truth: str, predicted: str, levels: Sequence[float]) -> DataFrame:
    """(level, groups, rank, half_width): the order statistic of the groups' greatest residuals.

    There is no interpolation; a level that needs more groups than there are gets a null width.
    """
    worst = df.groupBy(group).agg(F.max(F.abs(F.col(truth) - F.col(predicted))).alias("w"))
    counts = worst.groupBy("w").agg(F.count("*").alias("c"))
    run = cumulative(counts, "w", "c", "below")
    m = worst.agg(F.count("*").alias("groups"))
    each = m.select("groups", F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    need = each.select("level", "groups", F.ceil((F.col("groups") + 1) * F.col("level") - RANK_EPS).alias("rank"))
    found = run.crossJoin(F.broadcast(need)).where("below >= rank").groupBy("level").agg(F.min("w").alias("half_width"))
    return need.join(found, "level", "left").select("level", "groups", "rank", "half_width")


def conformal_intervals(df: DataFrame, predicted: str, fitted: DataFrame) -> DataFrame:
    """Rows with lower and upper for every level (a bounded number of levels)."""
    return df.crossJoin(F.broadcast(fitted.select("level", "half_width"))).withColumn("lower", F.col(predicted) - F.col("half_width")).withColumn("upper", F.col(predicted) + F.col("half_width"))


def coverage(df: DataFrame, group: str, truth: str) -> DataFrame:
    """Per level: share of rows inside, share of groups wholly inside, mean and median width."""
    inside = F.col(truth).between(F.col("lower"), F.col("upper"))
    groups = df.groupBy("level", group).agg(F.bool_and(inside).alias("whole")).groupBy("level").agg(F.avg(F.col("whole").cast("double")).alias("group_coverage"))
    rows = df.groupBy("level").agg(F.avg(inside.cast("double")).alias("record_coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"), F.median(F.col("upper") - F.col("lower")).alias("median_width"))
    return rows.join(groups, "level")


def group_summary(df: DataFrame, by: Sequence[str], value: str, count: str) -> DataFrame:
    """(by, median, mean, n, distinct): of a value, and how many different ``count`` a group has."""
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.count("*").alias("n"), F.countDistinct(count).alias("distinct"))


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and population deviation of an ensemble's predictions for each key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def fit_imputer(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of all columns in one aggregate; a column without values is left out."""
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double")) for c in columns]
    row = df.agg(*[F.median(x).alias(f"m{k}") for k, x in enumerate(clean)]).first()
    return {c: row[k] for k, c in enumerate(columns) if row[k] is not None}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Columns filled with their medians, and an indicator of what was missing."""
    made = {}
    for c, m in medians.items():
        clean = F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
        made[c], made[f"{c}_missing"] = F.coalesce(clean, F.lit(m)), clean.isNull().cast("double")
    return df.withColumns(made)


def fit_scaler(df: DataFrame, blocks: dict[str, Sequence[str]]) -> dict[str, tuple[float, float, float]]:
    """column -> (mean, population deviation, 1/sqrt of its block's width); constant columns are left out."""
    columns = [c for cs in blocks.values() for c in cs]
    row = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for cs in blocks.values():
        varied = [c for c in cs if row[f"s_{c}"] and row[f"s_{c}"] > 1e-12]
        for c in varied:
            out[c] = (row[f"m_{c}"], row[f"s_{c}"], 1.0 / len(varied) ** 0.5)
    return out


def scale(df: DataFrame, fitted: dict[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s * w for c, (m, s, w) in fitted.items()})
