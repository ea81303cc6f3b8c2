import random

import pytest

from percolith.operators import selection


def peeled(rows):
    left, out, layer = dict(rows), {}, 0
    while left:
        layer += 1
        front = [k for k, v in left.items() if not any(all(a <= b for a, b in zip(u, v)) and u != v for u in left.values())]
        out |= dict.fromkeys(front, layer)
        left = {k: v for k, v in left.items() if k not in front}
    return out


@pytest.mark.parametrize("n,size,width,most", [(400, 2, 40, 1 << 20), (400, 2, 40, 37), (90, 2, 1000, 20), (60, 1, 30, 7), (25, 3, 3, 0)])
def test_every_row_has_its_layer(spark, monkeypatch, n, size, width, most):
    monkeypatch.setattr(selection, "RANGE", most)
    rng = random.Random(n)
    rows = [(k, tuple(float(rng.randrange(width)) for _ in range(size))) for k in range(n)]
    rows += [(n + k, (5.0,) * size) for k in range(50)]
    names = ["k", "y", "x"][:size]
    df = spark.createDataFrame([(k, *v) for k, v in rows] + [(-1, *[None] * size), (-2, *[float("nan")] * size)], "id long, " + ", ".join(f"{c} double" for c in names))
    got = selection.pareto_layers(df.withColumn(names[-1], -df[names[-1]]), "id", dict.fromkeys(names[:-1], "min") | {names[-1]: "max"}).collect()
    assert len(got) == n + 52
    assert {r["id"]: r["layer"] for r in got} == peeled(rows) | {-1: None, -2: None}


def test_more_layers_than_the_old_cap(spark):
    got = selection.pareto_layers(spark.range(100).selectExpr("id", "double(id) x", "double(id) y"), "id", {"x": "min", "y": "min"}).collect()
    assert {r["id"]: r["layer"] for r in got} == {k: k + 1 for k in range(100)}
