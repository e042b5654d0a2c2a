"""Predictions and what they are worth: calibration, thresholds, curves, tests, gates.

A table of predictions has ``label``, ``predicted``, ``confidence``, ``margin``, ``entropy`` and
``probabilities`` (in the order of the classes). Every figure is built from partial aggregates.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.running import running

BINS = 10


def softmax(scores: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp((s - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def predictions(scored: DataFrame, classes: list, temperature: float = 1.0) -> DataFrame:
    """Adds probabilities, the class of the highest (the first of equals), confidence, margin and entropy."""
    names = F.array(*(F.lit(c) for c in classes))
    p = scored.withColumn("probabilities", softmax(F.col("scores"), temperature))
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    ordered = F.sort_array("probabilities", asc=False)
    second = F.coalesce(F.try_element_at(ordered, F.lit(2)), F.lit(0.0))
    entropy = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return p.withColumns({"predicted": F.element_at(names, best), "confidence": F.element_at(ordered, 1), "margin": F.element_at(ordered, 1) - second, "entropy": entropy})


def correct() -> Column:
    return (F.col("label") == F.col("predicted")).cast("bigint")


def confusion(p: DataFrame) -> DataFrame:
    return p.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(p: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class."""
    c = confusion(p)
    truth, said = c.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("support")), c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("said"))
    hit = c.where("label = predicted").select(F.col("label").alias("k"), F.col("n").alias("hit"))
    j = truth.join(said, "k", "full").join(hit, "k", "left").na.fill(0, ["support", "said", "hit"])
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("said"))
    return j.select(F.col("k").alias("label"), "support", F.round(F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def reliability(p: DataFrame, bins: int = BINS) -> DataFrame:
    """Bins of equal width: rows, mean confidence, accuracy."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("bigint")
    return p.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg(correct()).alias("accuracy"))


def ece(p: DataFrame, bins: int = BINS) -> DataFrame:
    """Expected calibration error: one row."""
    return reliability(p, bins).agg(F.sum("n").alias("rows"), F.round(F.try_divide(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")), 6).alias("ece"))


def brier_nll(p: DataFrame, classes: list) -> DataFrame:
    """Brier score (sum of squares over the classes) and negative log likelihood: one row."""
    names = F.array(*(F.lit(c) for c in classes))
    at = F.array_position(names, F.col("label")).cast("int")
    square = F.aggregate(F.arrays_zip(names.alias("c"), F.col("probabilities").alias("p")), F.lit(0.0), lambda a, z: a + F.pow(z["p"] - (z["c"] == F.col("label")).cast("double"), F.lit(2)))
    own = F.greatest(F.element_at("probabilities", at), F.lit(1e-15))
    return p.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(square), 6).alias("brier"), F.round(F.avg(-F.log(own)), 6).alias("nll"))


def temperature_grid(scored: DataFrame, classes: list, grid: list[float]) -> DataFrame:
    """Mean negative log likelihood for each temperature of a short grid."""
    names = F.array(*(F.lit(c) for c in classes))
    at = F.array_position(names, F.col("label")).cast("int")
    rows = scored.select("label", "scores", F.explode(F.array(*(F.lit(float(t)) for t in grid))).alias("t"))
    # The logarithm of the softmax itself, which no small temperature drives to zero.
    top = F.array_max("scores")
    nll = F.log(F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((s - top) / F.col("t")))) - (F.element_at("scores", at) - top) / F.col("t")
    return rows.groupBy("t").agg(F.avg(nll).alias("nll"))


def _pooled(tab: pa.Table) -> pa.Table:
    """Adjacent violators of one class, pooled: rows ``(class, p, n, hits)`` to the steps of the rising map."""
    order = np.argsort(tab["p"].to_numpy())
    steps: list[list[float]] = []
    for p, n, hits in zip(*(tab[c].to_numpy()[order].tolist() for c in ("p", "n", "hits"))):
        steps.append([p, n, hits])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            low = steps.pop(-2)
            steps[-1] = [low[0], steps[-1][1] + low[1], steps[-1][2] + low[2]]
    return pa.table({"class": pa.array([tab["class"][0].as_py()] * len(steps), pa.string()), "from_p": [s[0] for s in steps], "n": pa.array([s[1] for s in steps], pa.int64()), "calibrated": [s[2] / s[1] for s in steps]})


def isotonic_per_class(p: DataFrame, classes: list) -> DataFrame:
    """``(class, from_p, n, calibrated)``: for every class the rising step map from its probability to the share of rows that are of it.

    Probabilities are counted in steps of 0.0001 first, so a class is at most 10 001 rows, whatever the size of ``p``.
    """
    names = F.array(*(F.lit(str(c)) for c in classes))
    rows = p.select(F.col("label").cast("string").alias("label"), F.explode(F.arrays_zip(names.alias("class"), F.col("probabilities").alias("p"))).alias("z")).select("label", "z.class", F.round("z.p", 4).alias("p"))
    counts = rows.groupBy("class", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("class")).alias("hits"))
    return counts.groupBy("class").applyInArrow(_pooled, "class string, from_p double, n bigint, calibrated double")


def curve(p: DataFrame) -> DataFrame:
    """Risk and coverage: for every confidence the rows at or above it and how many are right.

    Rows of equal confidence enter together.
    """
    rows = p.select(F.round("confidence", 6).alias("confidence"), correct().alias("ok")).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))
    return running(rows, "confidence", {"covered": F.col("n"), "right": F.col("ok")})


def coverage_at(p: DataFrame, target: float = 0.98) -> DataFrame:
    """The lowest threshold above which precision is at least ``target`` throughout, and the widest coverage
    at which it is: one row; nulls if there is none.
    """
    c = curve(p).withColumn("precision", F.col("right") / F.col("covered"))
    bad = c.where(F.col("precision") < target).agg(F.max("confidence").alias("bad"), F.count(F.lit(1)).alias("n_bad"))
    # One row each.
    limit = bad.first()["bad"]
    total = p.count()
    steady = F.min(F.when((F.lit(limit).isNull()) | (F.col("confidence") > F.lit(limit)), F.col("confidence"))).alias("tau")
    widest = F.max(F.when(F.col("precision") >= target, F.col("covered"))).alias("most")
    return c.agg(steady, widest).select("tau", F.round(F.col("most") / F.lit(max(total, 1)), 6).alias("coverage"))


def aurc(p: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve: the mean, over rows, of the risk at their confidence: one row."""
    c = curve(p)
    return c.agg(F.sum("n").alias("rows"), F.round(F.try_divide(F.sum(F.col("n") * (1 - F.col("right") / F.col("covered"))), F.sum("n")), 6).alias("aurc"))


def auroc(p: DataFrame) -> DataFrame:
    """Probability that a right prediction is more confident than a wrong one (half for equals): one row."""
    c = curve(p).select("n", "ok", "covered", "right")
    wrong_above = F.col("covered") - F.col("right") - (F.col("n") - F.col("ok"))
    lost = F.sum(F.col("ok") * (wrong_above + (F.col("n") - F.col("ok")) / 2))
    pairs = F.sum("ok") * (F.sum("n") - F.sum("ok"))
    return c.agg(F.sum("n").alias("rows"), F.round(1 - F.try_divide(lost, pairs), 6).alias("auroc"))


def mcnemar(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Discordant pairs of two models on the same rows and the statistic with continuity correction: one row."""
    j = a.select(key, correct().alias("a")).join(b.select(key, correct().alias("b")), key)
    d = j.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    return d.withColumn("statistic", F.round(F.when(n > 0, F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), F.lit(2)) / n).otherwise(0.0), 6))


def bootstrap_accuracy(p: DataFrame, key: str, draws: int = 2000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Confidence interval of the accuracy by Poisson bootstrap: one row.

    The weight of a row in a draw depends on its key and the seed only; each task returns one sum per draw.
    """

    def run(batches):
        total = np.zeros((2, draws))
        for b in batches:
            for k, ok in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = np.random.Generator(np.random.Philox(key=seed, counter=[k & (2**63 - 1), 0, 0, 0])).poisson(1.0, draws)
                total[0] += w
                total[1] += w * ok
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total[0]), pa.array(total[1])], ["draw", "n", "ok"])

    sums = p.select(F.col(key).cast("bigint").alias("k"), correct().alias("ok")).mapInArrow(run, "draw bigint, n double, ok double")
    per = sums.groupBy("draw").agg(F.try_divide(F.sum("ok"), F.sum("n")).alias("accuracy"))
    side = (1 - level) / 2
    return per.agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.percentile("accuracy", F.lit(side)), 6).alias("low"), F.round(F.percentile("accuracy", F.lit(1 - side)), 6).alias("high"))


def promotion_gate(new: dict, old: dict, regressions: bool | None = None) -> dict:
    """Whether a new model may replace the old: F1 not 0.01 lower, ECE not 0.01 higher, coverage not lower, no
    class F1 0.05 lower; with a regression set also that it passes."""
    checks = {
        "macro_f1": new["macro_f1"] >= old["macro_f1"] - 0.01,
        "ece": new["ece"] <= old["ece"] + 0.01,
        "coverage": (new["coverage"] or 0) >= (old["coverage"] or 0),
        "class_f1": all(new["per_class"].get(k, 0) >= f - 0.05 for k, f in old["per_class"].items()),
    }
    if regressions is not None:
        checks["regressions"] = regressions
    return {**checks, "promoted": all(checks.values())}


def metrics(p: DataFrame, classes: list) -> dict:
    """The figures of one model, as the gate and the register of runs want them."""
    rows = per_class(p).collect()  # one per class
    return {
        "macro_f1": sum(r["f1"] for r in rows) / max(1, len(rows)),
        "ece": ece(p).first()["ece"],
        "coverage": coverage_at(p).first()["coverage"],
        "aurc": aurc(p).first()["aurc"],
        "auroc": auroc(p).first()["auroc"],
        "brier": brier_nll(p, classes).first()["brier"],
        "per_class": {str(r["label"]): r["f1"] for r in rows},
    }


_RUNS = "run_id bigint, model_type string, macro_f1 double, ece double, aurc double, auroc double, brier double, coverage double, per_class_f1 string, promoted boolean"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The register of runs; empty if there is none yet."""
    from docloom.sources.tables import path_exists

    path = f"{folder}/runs.parquet"
    return spark.read.schema(_RUNS).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], _RUNS)


def enter(spark: SparkSession, folder: str, model_type: str, m: dict, promoted: bool) -> int:
    """Appends a run to the register, promoted or not, and gives its number."""
    number = (runs(spark, folder).agg(F.max("run_id")).first()[0] or 0) + 1
    row = (number, model_type, *(m[c] for c in ("macro_f1", "ece", "aurc", "auroc", "brier", "coverage")), json.dumps(m["per_class"], sort_keys=True), bool(promoted))
    spark.createDataFrame([row], _RUNS).coalesce(1).write.mode("append").parquet(f"{folder}/runs.parquet")
    return number


def decide(p: DataFrame, distance: str, delta: float, tau: float | None, residual: str) -> DataFrame:
    """The residual class for what is too far from everything, AUTO above the threshold, else REVIEW."""
    auto = F.lit(False) if tau is None else F.col("confidence") >= F.lit(float(tau))
    return p.withColumn("decision", F.when(F.col(distance) > F.lit(float(delta)), F.lit(residual)).when(auto, "AUTO").otherwise("REVIEW"))
