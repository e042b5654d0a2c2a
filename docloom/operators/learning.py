"""The learning curve: an active arm against a random one, both from the same start set.

A round takes ``step`` further rows of the pool. The active arm scores the pool with the model of the rows it has
so far, takes the ``CANDIDATES`` smallest margins, parts them into ``step`` clusters and of each the smallest margin;
the random arm takes rows in a hashed order. Then the model is fitted and calibrated anew on all rows of the arm:
class means by cosine, and the temperature that is best for scores out of stratified folds. Labels of the pool are
looked at for chosen rows only, those of the held-out rows in the evaluation only.

Labels are what people give, so what a model learns from is bounded and fitted on the driver. The pool is scanned
once a round for all seeds; of it each task keeps the best candidates of a seed. All models are evaluated in few passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vectors
from docloom.operators import evaluate
from docloom.operators.running import running

CANDIDATES = 200
FOLDS = 5
#: Numbers of the models sent along with one pass, and of the scores a task holds at once.
MODEL_NUMBERS = 4 << 20
SCORE_NUMBERS = 1 << 20


def noise(salt: str):
    return F.md5(F.concat_ws(":", F.lit(salt), "vec_id"))


def means_of(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Mean vector of each class, at length 1; NaN for a class without rows, which is never predicted."""
    m = np.full((classes, x.shape[1]), np.nan)
    for c in np.unique(y):
        m[c] = x[y == c].mean(axis=0)
    return vectors.unit_rows(m)


def scores_of(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Cosines of rows and class means ``(models, classes, values)``; rounded, so that equal ones are equal in any batch."""
    models, classes, size = means.shape
    s = np.round(vectors.unit_rows(x) @ means.reshape(-1, size).T, 9).reshape(len(x), models, classes)
    return np.where(np.isnan(s), -np.inf, s)


def probabilities_of(scores: np.ndarray, temperature: np.ndarray) -> np.ndarray:
    e = np.exp((scores - scores.max(axis=2, keepdims=True)) / temperature[None, :, None])
    return e / e.sum(axis=2, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, grid: list[float]) -> tuple[np.ndarray, float]:
    """Class means of all rows and the temperature of least log loss on rows outside the fold that was fitted."""
    fold = np.zeros(len(y), int)
    for c in np.unique(y):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    s = np.full((len(y), classes), -np.inf)
    for f in range(FOLDS):
        out = fold == f
        if out.any() and not out.all():
            s[out] = scores_of(x[out], means_of(x[~out], y[~out], classes)[None])[:, 0]
    known = np.isfinite(s[np.arange(len(y)), y])
    s, own = s[known], y[known]
    loss = []
    for t in grid:
        top = s.max(axis=1)
        loss.append(np.mean(np.log(np.exp((s - top[:, None]) / t).sum(axis=1)) - (s[np.arange(len(own)), own] - top) / t) if len(own) else 0.0)
    return means_of(x, y, classes), grid[int(np.argmin(loss))]


def diverse(x: np.ndarray, margin: np.ndarray, k: int, seed: list[int], most: int = 50) -> list[int]:
    """Of each of ``k`` clusters the row of the smallest margin; what clusters leave open, by margin. Rows come in order of margin."""
    if len(x) <= k:
        return list(range(len(x)))
    rng, x = np.random.default_rng(seed), vectors.unit_rows(x)
    centre = x[[rng.integers(len(x))]]
    while len(centre) < k:
        far = ((x[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1)
        if far.sum() <= 0:
            break
        centre = np.concatenate([centre, x[[rng.choice(len(x), p=far / far.sum())]]])
    group = None
    for _ in range(most):
        now = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        if group is not None and (now == group).all():
            break
        group = now
        centre = np.stack([x[group == g].mean(axis=0) if (group == g).any() else centre[g] for g in range(len(centre))])
    own = [int(np.flatnonzero(group == g)[np.argmin(margin[group == g])]) for g in np.unique(group)]
    rest = [i for i in range(len(x)) if i not in set(own)]
    return sorted([*own, *rest[: k - len(own)]])


def _candidates(pool: DataFrame, models: list[tuple[np.ndarray, float]], taken: list[np.ndarray]) -> list[list]:
    """Per model the rows of the smallest margins that it has no label of yet."""
    stack, temperature, n = np.stack([m for m, _ in models]), np.array([t for _, t in models]), len(models)
    step = max(1, SCORE_NUMBERS // (stack.shape[0] * stack.shape[1]))

    def run(batches):
        best = [(np.empty(0), np.empty(0, np.int64), None) for _ in range(n)]
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                ids, x = part.column(0).to_numpy(), vectors._matrix(part.column(1))
                p = probabilities_of(scores_of(x, stack), temperature)
                p.sort(axis=2)
                margin = np.round(p[:, :, -1] - (p[:, :, -2] if p.shape[2] > 1 else 0), 9)
                for m in range(n):
                    free = np.flatnonzero(~np.isin(ids, taken[m]))
                    old = best[m]
                    a, i = np.concatenate([old[0], margin[free, m]]), np.concatenate([old[1], ids[free]])
                    v = x[free] if old[2] is None else np.concatenate([old[2], x[free]])
                    keep = np.lexsort((i, a))[:CANDIDATES]
                    best[m] = (a[keep], i[keep], v[keep])
        for m, (a, i, v) in enumerate(best):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), m)), pa.array(a), pa.array(i), pa.array(list(v), pa.list_(pa.float64()))], ["m", "margin", "vec_id", "embedding"])

    found = pool.select("vec_id", "embedding").mapInArrow(run, "m bigint, margin double, vec_id bigint, embedding array<double>")
    w = Window.partitionBy("m").orderBy("margin", "vec_id")
    out: list[list] = [[] for _ in range(n)]
    for r in found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= CANDIDATES).orderBy("m", "r").collect():
        out[r["m"]].append(r)
    return out


def arms(pool: DataFrame, classes: list, rounds: int, seeds: int, step: int, start: int, grid: list[float]) -> list[dict]:
    """Every model of the experiment: ``arm, round, seed, ids`` (what it was fitted on, in order), ``means, temperature``."""
    code = {c: i for i, c in enumerate(classes)}
    picks: dict[tuple, list] = {}
    w = Window.partitionBy("seed", "label").orderBy("o", "vec_id")
    drawn = pool.select("vec_id", "label", "embedding", F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), noise(f"start-{s}").alias("o")) for s in range(seeds)))).alias("d")).select("vec_id", "label", "embedding", "d.*")
    first = drawn.withColumn("r", F.row_number().over(w)).where(F.col("r") <= start).orderBy("seed", "o", "vec_id").collect()
    later = {}
    for s in range(seeds):
        picks["active", s] = [r for r in first if r["seed"] == s]
        picks["random", s] = list(picks["active", s])
        own = {r["vec_id"] for r in picks["random", s]}
        order = pool.select("vec_id", "label", "embedding", noise(f"curve-{s}").alias("o")).orderBy("o", "vec_id").limit(rounds * step + len(own)).collect()
        later[s] = [r for r in order if r["vec_id"] not in own]
    out = []

    def fitted(arm, seed, n):
        rows = picks[arm, seed]
        x = np.array([r["embedding"] for r in rows], float).reshape(len(rows), -1)
        means, t = fit(x, np.array([code[r["label"]] for r in rows], int), len(classes), grid)
        out.append({"arm": arm, "round": n, "seed": seed, "ids": [r["vec_id"] for r in rows], "means": means, "temperature": t})
        return means, t

    if not first:
        return out
    active = [fitted("active", s, 0) for s in range(seeds)]
    for s in range(seeds):
        fitted("random", s, 0)
    for n in range(1, rounds + 1):
        # Once every row is taken there is nothing left to choose.
        found = [] if n > 1 and not any(chosen.values()) else _candidates(pool, active, [np.array([r["vec_id"] for r in picks["active", s]], np.int64) for s in range(seeds)])
        chosen = {}
        for s, c in enumerate(found):
            at = diverse(np.array([r["embedding"] for r in c], float), np.array([r["margin"] for r in c]), step, [s, n])
            chosen[s] = [c[i]["vec_id"] for i in at]
        # The labels of the chosen rows, and of no others, are given now.
        asked = sorted({i for ids in chosen.values() for i in ids})
        told = {r["vec_id"]: r for r in pool.where(F.col("vec_id").isin(asked)).select("vec_id", "label", "embedding").collect()} if asked else {}
        for s in range(seeds):
            picks["active", s] += [told[i] for i in chosen.get(s, [])]
            picks["random", s] += later[s][(n - 1) * step : n * step]
        active = [fitted("active", s, n) for s in range(seeds)]
        for s in range(seeds):
            fitted("random", s, n)
    return out


def _tally(stack: np.ndarray, temperature: np.ndarray, first: int, classes: list):
    names, (models, n, _) = np.array(classes), stack.shape
    step = max(1, SCORE_NUMBERS // (models * n))
    m = np.arange(models)

    def batch(what, model, k, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), what)), pa.array(model + first), pa.array(k), *(pa.array(v.astype(float)) for v in (a, b, c))], ["what", "m", "k", "a", "b", "c"])

    def run(batches):
        by_class, by_bin = np.zeros((3, models * n)), np.zeros((3, models * evaluate.BINS))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                truth = np.searchsorted(names, part.column(0).to_numpy())
                s = scores_of(vectors._matrix(part.column(1)), stack)
                said = s.argmax(axis=2)
                sure = probabilities_of(s, temperature).max(axis=2)
                ok = said == truth[:, None]
                own = m[None] * n
                by_class += [np.bincount(v.ravel(), w, models * n) for v, w in ((own + truth[:, None], None), (own + said, None), (own + said, ok.ravel()))]
                at = (m[None] * evaluate.BINS + np.minimum(np.floor(sure * evaluate.BINS), evaluate.BINS - 1).astype(int)).ravel()
                by_bin += [np.bincount(at, v, models * evaluate.BINS) for v in (None, ok.ravel(), sure.ravel())]
                key, back = np.unique((np.broadcast_to(m, sure.shape) * 2_000_000 + np.round(sure * 1e6).astype(np.int64)).ravel(), return_inverse=True)
                counts = [np.bincount(back, v, len(key)) for v in (None, ok.ravel())]
                yield batch(1, key // 2_000_000, key % 2_000_000, *counts, np.zeros(len(key)))
        yield batch(0, np.repeat(m, n), np.tile(np.arange(n), models), *by_class)
        yield batch(2, np.repeat(m, evaluate.BINS), np.tile(np.arange(evaluate.BINS), models), *by_bin)

    return run


def evaluated(held: DataFrame, models: list[dict], classes: list, target: float) -> DataFrame:
    """``(m, macro_f1, ece, coverage)`` of every model on the same rows; coverage is 0 if no threshold has the precision."""
    size = max(1, MODEL_NUMBERS // max(1, models[0]["means"].size))
    parts = [held.select("label", "embedding").mapInArrow(_tally(np.stack([x["means"] for x in models[i : i + size]]), np.array([x["temperature"] for x in models[i : i + size]]), i, classes), "what bigint, m bigint, k bigint, a double, b double, c double") for i in range(0, len(models), size)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy("what", "m", "k").agg(*(F.sum(c).alias(c) for c in "abc"))
    f1 = rows.where("what = 0 and a + b > 0").groupBy("m").agg(F.avg(2 * F.col("c") / (F.col("a") + F.col("b"))).alias("macro_f1"))
    bins = rows.where("what = 2 and a > 0").groupBy("m").agg((F.sum(F.abs(F.col("c") - F.col("b"))) / F.sum("a")).alias("ece"))
    curve = running(rows.where("what = 1").select("m", (F.col("k") / 1e6).alias("k"), "a", "b"), "k", {"covered": F.col("a"), "right": F.col("b")}, ["m"])
    most = curve.groupBy("m").agg((F.coalesce(F.max(F.when(F.col("right") >= target * F.col("covered"), F.col("covered"))), F.lit(0.0)) / F.max("covered")).alias("coverage"))
    return f1.join(bins, "m").join(most, "m")
