"""Regressors, grouped out-of-fold runs, nested selection, and the distance to the training domain.

Models are ``pyspark.ml`` pipelines.  There is no support-vector regressor or extra-trees in it: the
registry gives a kernel-free linear model and a feature-subset forest in their places and says so.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from . import selection, stats
from .checks import CheckError, require_none

#: id -> (stands for itself?, what it is)
REGISTRY = {
    "dummy_mean": (True, "mean of the training target"),
    "random_forest": (True, "RandomForestRegressor"),
    "extra_trees": (False, "RandomForestRegressor without bootstrap, one feature in three"),
    "hist_gb": (False, "GBTRegressor"),
    "xgboost": (False, "GBTRegressor"),
    "lightgbm": (False, "GBTRegressor"),
    "catboost": (False, "GBTRegressor"),
    "svr": (False, "LinearRegression with Huber loss"),
}


def estimator(name: str, label: str, seed: int):
    """The regressor of that id; ``None`` for the mean."""
    if name not in REGISTRY:
        raise CheckError(f"no model {name}; there are {sorted(REGISTRY)}")
    common = {"featuresCol": "features", "labelCol": label}
    if name == "dummy_mean":
        return None
    if name == "svr":
        return LinearRegression(**common, loss="huber", maxIter=50, regParam=0.01)
    if name in ("random_forest", "extra_trees"):
        whole = name == "extra_trees"
        return RandomForestRegressor(**common, numTrees=40, maxDepth=8, seed=seed, bootstrap=not whole, featureSubsetStrategy="onethird")
    return GBTRegressor(**common, maxIter=20, maxDepth=4, stepSize=0.1, seed=seed)


class Fitted:
    """Medians, scaling and a model, all from training rows; ``predict`` applies them."""

    def __init__(self, name: str, train: DataFrame, features: Sequence[str], label: str, seed: int = 7):
        self.medians = stats.fit_imputer(train, features)
        filled = stats.impute(train, self.medians)
        self.inputs = [c for m in self.medians for c in (m, f"{m}_missing")]
        self.scaling = stats.fit_scaler(filled, {"all": list(self.medians)}) if name == "svr" else {}
        self.name, self.label, self.mean, self.model = name, label, None, None
        model = estimator(name, label, seed)
        if model is None or not self.inputs:
            self.mean = train.agg(F.avg(label)).first()[0]
        else:
            self.model = Pipeline(stages=[VectorAssembler(inputCols=self.inputs, outputCol="features"), model]).fit(stats.scale(filled, self.scaling))

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("prediction", F.lit(float(self.mean)))
        keep = df.withColumn("_row", F.struct(*df.columns))
        out = self.model.transform(stats.scale(stats.impute(keep, self.medians), self.scaling))
        return out.select("_row.*", "prediction")


    def save(self, folder: str) -> None:
        """Parameters as JSON and the pipeline in Spark's own form, below one folder."""
        spark = SparkSession.active()
        sinks.write_file(spark, json.dumps({"name": self.name, "label": self.label, "medians": self.medians, "scaling": {k: list(v) for k, v in self.scaling.items()}, "mean": self.mean}), f"{folder}/parameters.json")
        if self.model is not None:
            self.model.write().overwrite().save(f"{folder}/pipeline")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Fitted:
        from pyspark.ml import PipelineModel

        out, said = cls.__new__(cls), _read_json(spark, f"{folder}/parameters.json")
        out.name, out.label, out.medians, out.mean = said["name"], said["label"], said["medians"], said["mean"]
        out.scaling = {k: tuple(v) for k, v in said["scaling"].items()}
        out.inputs = [c for m in out.medians for c in (m, f"{m}_missing")]
        out.model = PipelineModel.load(f"{folder}/pipeline") if out.mean is None else None
        return out


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def out_of_fold(df: DataFrame, folds: DataFrame, name: str, features: Sequence[str], label: str, group: str, key: str, base_seed: int = 7) -> DataFrame:
    """Every row predicted by the model that didn't see its fold; ``folds`` is (group, fold)."""
    from ..functions.text import derived_seed

    rows = df.join(folds, group)
    require_none(selection.split_violations(rows, key, group, "fold"), "folds")
    ids = sorted(r.fold for r in folds.select("fold").distinct().collect())
    out = None
    for k in ids:
        seed = df.sparkSession.range(1).select(derived_seed(base_seed, F.lit(name), F.lit(k))).first()[0]
        fitted = Fitted(name, rows.where(F.col("fold") != k), features, label, seed)
        part = fitted.predict(rows.where(F.col("fold") == k)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def metrics(predictions: DataFrame, label: str, group: str, with_kendall: bool = True) -> DataFrame:
    """Metrics of one model's out-of-fold predictions, and the spread of its folds."""
    folds = predictions.groupBy("fold").agg(F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("m")).agg(F.avg("m").alias("fold_mae"), F.stddev_pop("m").alias("fold_mae_std"))
    return stats.regression_metrics(predictions, label, "prediction", group, with_kendall).crossJoin(F.broadcast(folds))  # one row each


def nested_selection(df: DataFrame, folds: DataFrame, names: Sequence[str], features: Sequence[str], label: str, group: str, key: str, inner: int = 3) -> DataFrame:
    """Out-of-fold predictions where each fold's model is chosen on its own training groups only."""
    rows = df.join(folds, group)
    out = None
    for k in sorted(r.fold for r in folds.select("fold").distinct().collect()):
        train, test = rows.where(F.col("fold") != k).drop("fold"), rows.where(F.col("fold") == k)
        parts = selection.group_kfold(train, group, inner)
        table = None
        for name in names:
            row = metrics(out_of_fold(train, parts, name, features, label, group, key), label, group, False).withColumn("model", F.lit(name))
            table = row if table is None else table.unionByName(row)
        best = stats.rank_models(table).where("rank = 1").first()["model"]
        part = Fitted(best, train, features, label).predict(test).withColumn("model", F.lit(best))
        out = part if out is None else out.unionByName(part)
    return out


class Domain:
    """Distance of rows to the training groups in balanced principal components.

    Columns are imputed, scaled by population deviation and balanced by block; components are kept to 95 %
    of the variance.  A row's distance is that to its fifth nearest group other than its own; thresholds are
    weighted quantiles of the training distances, each group weighing the same.
    """

    def __init__(self, train: DataFrame, blocks: dict[str, Sequence[str]], group: str, key: str, variance: float = 0.95, nearest: int = 5):
        self.blocks, self.group, self.key, self.nearest = blocks, group, key, nearest
        self.medians = stats.fit_imputer(train, [c for cs in blocks.values() for c in cs])
        filled = stats.impute(train, self.medians)
        self.scaling = stats.fit_scaler(filled, {b: [c for c in cs if c in self.medians] for b, cs in blocks.items()})
        names = list(self.scaling)
        ready = VectorAssembler(inputCols=names, outputCol="v").transform(stats.scale(filled, self.scaling))
        full = PCA(k=len(names), inputCol="v", outputCol="z").fit(ready)
        self.k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), variance) + 1)
        self.matrix = full.pc.toArray()[:, : min(self.k, len(names))]
        self.train = self.embed(train)
        distances = self._distances(self.train)
        sizes = self.train.groupBy(group).agg((1.0 / F.count("*")).alias("weight"))
        self.reference = distances.join(self.train.select(key, group), key).join(sizes, group)
        self.limits = {p: stats.weighted_quantile(self.reference, "distance", "weight", p).first()[0] for p in (0.95, 0.99)}

    @property
    def names(self) -> list[str]:
        return [f"z{i}" for i in range(self.matrix.shape[1])]

    def embed(self, df: DataFrame) -> DataFrame:
        x = stats.scale(stats.impute(df, self.medians), self.scaling)
        columns = list(self.scaling)
        z = [sum((F.col(c) * float(self.matrix[j, i]) for j, c in enumerate(columns)), F.lit(0.0)).alias(f"z{i}") for i in range(self.matrix.shape[1])]
        return x.select(self.key, *([self.group] if self.group in df.columns else []), *z)

    def _distances(self, embedded: DataFrame) -> DataFrame:
        d = selection.group_distances(self.train, embedded, self.group, self.names, self.key)
        return selection.kth_group_distance(d, self.key, self.group, self.nearest)

    def score(self, df: DataFrame) -> DataFrame:
        """(key, distance, percentile, warning_95, warning_99)."""
        d = stats.weighted_percentile(self.reference, "distance", "weight", self._distances(self.embed(df)), "distance")
        return d.withColumns({f"warning_{round(100 * p)}": F.col("percentile") >= p for p in self.limits})

    def score_graphs(self, scored: DataFrame, graph: str) -> DataFrame:
        """A graph's greatest distance, and the share of training groups whose own greatest is no greater."""
        own = self.reference.groupBy(self.group).agg(F.max("distance").alias("distance")).withColumn("w", F.lit(1.0))
        top = scored.groupBy(graph).agg(F.max("distance").alias("distance"))
        return stats.weighted_percentile(own, "distance", "w", top, "distance")

    def save(self, folder: str) -> None:
        """Parameters as JSON; the embedded training rows and reference distances as Parquet."""
        sinks.write_file(self.train.sparkSession, json.dumps(self.parameters() | {"limits": {str(k): v for k, v in self.limits.items()}, "blocks": {b: list(c) for b, c in self.blocks.items()}, "group": self.group, "key": self.key}), f"{folder}/parameters.json")
        self.train.write.mode("overwrite").parquet(f"{folder}/train")
        self.reference.write.mode("overwrite").parquet(f"{folder}/reference")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Domain:
        out, said = cls.__new__(cls), _read_json(spark, f"{folder}/parameters.json")
        out.blocks, out.group, out.key, out.nearest, out.medians = said["blocks"], said["group"], said["key"], said["nearest"], said["medians"]
        out.scaling = {k: tuple(v) for k, v in said["scaling"].items()}
        out.matrix, out.limits = np.array(said["matrix"]), {float(k): v for k, v in said["limits"].items()}
        out.train, out.reference = spark.read.parquet(f"{folder}/train"), spark.read.parquet(f"{folder}/reference")
        return out

    def parameters(self) -> dict:
        return {"medians": self.medians, "scaling": self.scaling, "matrix": self.matrix.tolist(), "limits": self.limits, "nearest": self.nearest}


class FrozenModel:
    """A fitted model with its conformal half-widths and its domain, as one thing that is saved, loaded and asked.

    ``predict`` gives prediction, lower and upper bounds of each level, distance to the domain with its percentile
    and warnings, and, for a forest, the spread of its trees.
    """

    def __init__(self, fitted: Fitted, widths: dict[float, float], domain: Domain):
        self.fitted, self.widths, self.domain = fitted, widths, domain

    @classmethod
    def fit(cls, name: str, train: DataFrame, calibration: DataFrame, blocks: dict[str, Sequence[str]], label: str, group: str, key: str, levels: Sequence[float] = (0.8, 0.9)) -> FrozenModel:
        fitted = Fitted(name, train, [c for cs in blocks.values() for c in cs], label)
        widths = stats.conformal_fit(fitted.predict(calibration), group, label, "prediction", levels).collect()
        return cls(fitted, {r.level: r.half_width for r in widths}, Domain(train, blocks, group, key))

    def save(self, folder: str) -> None:
        self.fitted.save(f"{folder}/model")
        self.domain.save(f"{folder}/domain")
        sinks.write_file(SparkSession.active(), json.dumps({str(k): v for k, v in self.widths.items()}), f"{folder}/widths.json")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FrozenModel:
        return cls(Fitted.load(spark, f"{folder}/model"), {float(k): v for k, v in _read_json(spark, f"{folder}/widths.json").items()}, Domain.load(spark, f"{folder}/domain"))

    def predict(self, df: DataFrame) -> DataFrame:
        key, out = self.domain.key, self.fitted.predict(df)
        for level, width in sorted(self.widths.items()):
            name = round(100 * level)
            out = out.withColumns({f"lower{name}": F.col("prediction") - width, f"upper{name}": F.col("prediction") + width})
        score = self.domain.score(df)
        out = out.join(score.select(key, F.col("distance").alias("ood_distance"), F.col("percentile").alias("ood_percentile"), *[c for c in score.columns if c.startswith("warning_")]), key)
        if self.fitted.model is not None and hasattr(self.fitted.model.stages[-1], "trees"):
            spread = stats.spread(tree_predictions(self.fitted, df).withColumnRenamed("prediction", "_p"), key, "_p")
            out = out.join(spread.select(key, F.col("spread").alias("ensemble_spread")), key)
        return out


def tree_predictions(fitted: Fitted, df: DataFrame) -> DataFrame:
    """(key columns, tree, prediction) of every tree of a forest, for the spread among them."""
    forest = fitted.model.stages[-1]
    ready = fitted.model.stages[0].transform(stats.scale(stats.impute(df.withColumn("_row", F.struct(*df.columns)), fitted.medians), fitted.scaling))
    names = [f"_p{i}" for i in range(len(forest.trees))]
    for name, tree in zip(names, forest.trees, strict=True):
        ready = tree.copy().setPredictionCol(name).transform(ready)
    return ready.select("_row.*", F.posexplode(F.array(*names)).alias("tree", "prediction"))
