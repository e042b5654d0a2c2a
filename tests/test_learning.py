"""The learning curve: what a round may look at, and its figures against the operators of evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluate, learning
from docloom.plans import model_queries

GRID = [0.05, 0.2, 1.0]


def _vectors(n=240, classes=3, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, 5)) + 1.2 * np.eye(classes, 5)[y]
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "vec_id long, embedding array<double>, label int").repartition(3)


def test_rounds_follow_the_model_so_far(spark):
    x, y = _vectors()
    run = learning.arms(_frame(spark, x, y), [0, 1, 2], 2, 2, 7, 2, GRID)
    at = {(m["arm"], m["seed"], m["round"]): m for m in run}
    for s in (0, 1):
        assert at["active", s, 0]["ids"] == at["random", s, 0]["ids"] and len(at["active", s, 0]["ids"]) == 6
        for n in (1, 2):
            for arm in ("active", "random"):
                before, now = at[arm, s, n - 1]["ids"], at[arm, s, n]["ids"]
                assert now[: len(before)] == before and len(set(now)) == len(now) == len(before) + 7
            before, now = at["active", s, n - 1], at["active", s, n]["ids"]
            # Margins by the model of the round before, which knows its own rows only.
            ids = before["ids"]
            means, t = learning.fit(x[ids], y[ids], 3, GRID)
            p = np.sort(learning.probabilities_of(learning.scores_of(x, means[None]), np.array([t]))[:, 0], axis=1)
            margin = np.round(p[:, -1] - p[:, -2], 9)
            free = sorted(set(range(len(x))) - set(ids), key=lambda i: (margin[i], i))[: learning.CANDIDATES]
            assert set(now[len(ids) :]) == {free[i] for i in learning.diverse(x[free], margin[free], 7, [s, n])}
    # Labels of rows that no arm has asked for change nothing.
    asked = {i for m in run for i in m["ids"]}
    other = np.where(np.isin(np.arange(len(y)), list(asked)), y, (y + 1) % 3)
    starts = {i for m in run if m["round"] == 0 for i in m["ids"]}
    again = learning._candidates(_frame(spark, x, other), [(at["active", 0, 1]["means"], at["active", 0, 1]["temperature"])], [np.array(at["active", 0, 1]["ids"])])
    assert starts and {r["vec_id"] for r in again[0]} >= set(at["active", 0, 2]["ids"]) - set(at["active", 0, 1]["ids"])


def test_curve_figures_are_those_of_evaluation(spark):
    x, y = _vectors()
    held = _frame(spark, x, y)
    models = [{"means": learning.means_of(x[:k], y[:k], 3), "temperature": t} for k, t in ((20, 0.2), (60, 0.05), (6, 1.0))]
    got = {r.m: r for r in learning.evaluated(held, models, [0, 1, 2], 0.8).collect()}
    for i, m in enumerate(models):
        s = learning.scores_of(x, m["means"][None])[:, 0]
        scored = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, s)], "label int, scores array<double>")
        p = evaluate.predictions(scored, [0, 1, 2], m["temperature"])
        assert got[i].macro_f1 == pytest.approx(evaluate.per_class(p).agg(F.avg("f1")).first()[0], abs=1e-5)
        assert got[i].ece == pytest.approx(evaluate.ece(p).first().ece, abs=1e-5)
        assert got[i].coverage == pytest.approx(evaluate.coverage_at(p, 0.8).first().coverage or 0, abs=1e-5)


def test_diversity_and_small_pools():
    x = np.repeat(np.eye(4), 10, axis=0)
    assert {i // 10 for i in learning.diverse(x, np.arange(40) / 40, 4, [1, 1])} == {0, 1, 2, 3}
    assert len(learning.diverse(np.ones((40, 4)), np.arange(40) / 40, 4, [1, 1])) == 4
    assert learning.diverse(np.ones((3, 4)), np.zeros(3), 4, [1, 1]) == [0, 1, 2]


def test_curve_query(spark, tmp_path):
    x, y = _vectors(400)
    _frame(spark, x, y).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {(r.arm, r.round): r for r in model_queries.learning_curve(spark, str(tmp_path), rounds=3, seeds=3).collect()}
    assert rows["active", 0][2:] == rows["random", 0][2:] and {r.labels for r in rows.values()} == {15, 40, 65, 90}
    assert all(r[f"{c}_low"] <= r[c] <= r[f"{c}_high"] for r in rows.values() for c in ("macro_f1", "ece", "coverage"))


def test_small_pool_ends(spark):
    x, y = _vectors(30)
    run = learning.arms(_frame(spark, x, y), [0, 1, 2], 5, 2, 9, 2, GRID)
    sizes = {(m["arm"], m["round"]): len(m["ids"]) for m in run}
    assert len(run) == 24 and all(sizes[a, n] == min(30, 6 + 9 * n) for a, n in sizes)


def test_readings(spark, monkeypatch):
    a, b = [0.5, 0.7, 0.8, 0.80], [0.5, 0.6, 0.7, 0.81]
    data = [(arm, n, 100 + 25 * n, v, v - 0.02, v + 0.02) for arm, c in (("active", a), ("random", b)) for n, v in enumerate(c)]
    curve = spark.createDataFrame(data, "arm string, round long, labels long, macro_f1 double, macro_f1_low double, macro_f1_high double")
    monkeypatch.setattr(model_queries, "learning_curve", lambda *_: curve)
    r = model_queries.learning_curve_readings(spark, "").first()
    assert r.area_between == pytest.approx((0 + 0.1 + 0.1 - 0.01) / 4)
    assert (r.level, r.active_labels, r.random_labels) == (0.8, 150, 175) and r.label_saving == pytest.approx(175 / 150, abs=1e-6)
    assert r.active_saturation == 150 and r.random_saturation is None
