import random

import pytest

from percolith.operators import checks, models, selection, stats


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = [(k, f"g{k % 12:02d}", x := rng.uniform(-1, 1), None if k % 9 == 0 else rng.uniform(0, 5), 2 * x + 0.1 * rng.random()) for k in range(120)]
    return spark.createDataFrame(rows, "key long, group string, x double, y double, label double").cache()


BLOCKS = {"a": ["x"], "b": ["y"]}


def test_out_of_fold_and_selection(data):
    folds = selection.group_kfold(data, "group", 2)
    out = models.out_of_fold(data, folds, "svr", ["x", "y"], "label", "group", "key")
    assert out.count() == 120 and out.select("key").distinct().count() == 120
    good, mean = (models.metrics(models.out_of_fold(data, folds, m, ["x", "y"], "label", "group", "key"), "label", "group", False).first() for m in ("svr", "dummy_mean"))
    assert good.mae < 0.2 < mean.mae and good.fold_mae_std >= 0
    picked = models.nested_selection(data, folds, ["dummy_mean", "svr"], ["x", "y"], "label", "group", "key", inner=2)
    assert {r.model for r in picked.select("model").distinct().collect()} == {"svr"} and picked.count() == 120
    with pytest.raises(checks.CheckError):
        models.estimator("none", "label", 1)
    with pytest.raises(ValueError):
        selection.group_kfold(data, "group", 13)


def test_frozen_models_give_the_same_when_loaded(spark, data, tmp_path):
    train, rest = data.where("group < 'g09'"), data.where("group >= 'g09'")
    frozen = models.FrozenModel.fit("svr", train, train, BLOCKS, "label", "group", "key")
    frozen.save(str(tmp_path / "m"))
    again = models.FrozenModel.load(spark, str(tmp_path / "m"))
    ask = rest.drop("label").limit(12).cache()
    a, b = ({r.key: r for r in m.predict(ask).collect()} for m in (frozen, again))
    assert set(a) == {r.key for r in ask.collect()}
    for k, r in a.items():
        assert r.prediction == pytest.approx(b[k].prediction, abs=1e-9) and r.ood_distance == pytest.approx(b[k].ood_distance)
        assert r.lower90 <= r.lower80 <= r.prediction <= r.upper80 <= r.upper90
        assert r.warning_95 == (r.ood_percentile >= 0.95) and r.warning_99 == (r.ood_percentile >= 0.99)
    assert frozen.domain.score_graphs(frozen.domain.score(ask).selectExpr("*", "key % 2 graph"), "graph").count() == 2


def test_trees_of_a_forest(data):
    fitted = models.Fitted("random_forest", data, ["x", "y"], "label")
    out = models.tree_predictions(fitted, data.limit(3)).collect()
    one = fitted.predict(data.limit(3)).collect()
    assert len(out) == 3 * 40 and {r.tree for r in out} == set(range(40))
    assert all(sum(r.prediction for r in out if r.key == p.key) / 40 == pytest.approx(p.prediction) for p in one)


def test_the_training_row_at_the_threshold_warns(data):
    domain = models.Domain(data, BLOCKS, "group", "key")
    out = domain.score(data).collect()
    assert any(r.warning_95 for r in out) and all(r.warning_95 == (r.distance >= domain.limits[0.95]) for r in out)


def test_too_few_groups_are_refused(data):
    few = data.where("group < 'g03'")
    d = selection.group_distances(few.fillna(0.0), few.fillna(0.0), "group", ["x", "y"], "key")
    assert selection.kth_group_distance(d, "key", "group", 2).count() == few.count()
    with pytest.raises(Exception, match="fewer than 3 other groups"):
        selection.kth_group_distance(d, "key", "group", 3).collect()


def test_splits(data):
    part = selection.hash_split(data, "group", 0.2)
    counts = {r.part: r["count"] for r in part.groupBy("part").count().collect()}
    assert counts == {"calibration": 9, "proper_train": 3}  # a level of 0.9 takes nine groups
    assert selection.hash_split(data, "group", 0.2).collect().sort() == part.collect().sort()
    with pytest.raises(ValueError):
        selection.hash_split(data.where("group < 'g09'"), "group", 0.2)
    assert [stats.min_calibration_groups(x) for x in (0.5, 0.8, 0.9, 0.95)] == [1, 4, 9, 19]
    import hashlib

    rows = data.sparkSession.createDataFrame([("b", "train"), ("a", "train"), ("c", "test")], "k string, part string")
    assert selection.split_hash(rows, "k", "part") == hashlib.sha256(b'{"test_record_ids":["c"],"train_record_ids":["a","b"]}').hexdigest()
    with pytest.raises(ValueError):
        selection.leave_one_group_out(data.where("group = 'g00'"), "group")
    assert selection.hash_sample(data, "key", 7, 1).count() == 7
    assert {r.key for r in selection.hash_sample(data, "key", 7, 1).collect()} == {r.key for r in selection.hash_sample(data.repartition(5), "key", 7, 1).collect()}
