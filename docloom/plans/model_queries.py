"""Queries over embeddings: prototypes, neighbours, calibration, curves, review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import vectors
from docloom.operators import evaluate, learning
from docloom.operators.running import percentile, running
from docloom.session import materialize, shared_path, table

TEMPERATURE = 0.1
TARGET = 0.9
#: Precision of the learning curve's coverage, and the labels at which the saving is read.
CURVE_TARGET = 0.98
SAVING_AT = 150
GRID = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _scored(spark, sf_dir, metric="cosine"):
    df = _emb(spark, sf_dir)
    classes, means = vectors.centroids(df)
    return vectors.scores(df, means, ["vec_id", "label"], metric=metric), classes


def _predictions(spark, sf_dir, metric="cosine"):
    scored, classes = _scored(spark, sf_dir, metric)
    return evaluate.predictions(scored, classes, TEMPERATURE), classes


def _unit(column: str):
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def nearest_centroid(spark, sf_dir):
    """Class of the nearest mean by cosine, with confidence, margin and entropy."""
    p, _ = _predictions(spark, sf_dir)
    return p.select("vec_id", "label", "predicted", *(F.round(c, 6).alias(c) for c in ("confidence", "margin", "entropy")))


def knn_ood(spark, sf_dir):
    """Distance of every fiftieth vector to the mean of its ten nearest neighbours."""
    df = _emb(spark, sf_dir)
    near = vectors.nearest(df.where("vec_id % 50 = 0"), df, 10)
    n = near.join(df.select(F.col("vec_id").alias("neighbour"), "embedding"), "neighbour").select("query", F.posexplode("embedding").alias("i", "x"))
    mean = n.groupBy("query", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    own = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.posexplode("embedding").alias("i", "x"))
    j = mean.join(own, ["query", "i"]).groupBy("query").agg(F.sum(F.col("x") * F.col("m")).alias("d"), F.sum(F.col("x").cast("double") * F.col("x")).alias("a"), F.sum(F.col("m") * F.col("m")).alias("b"))
    return j.select(F.col("query").alias("vec_id"), F.round(1 - F.col("d") / F.sqrt(F.col("a") * F.col("b")), 5).alias("distance"))


def nearest_neighbours(spark, sf_dir):
    """The five nearest vectors of every fiftieth."""
    df = _emb(spark, sf_dir)
    return vectors.nearest(df.where("vec_id % 50 = 0"), df, 5).select("query", "neighbour", "rank", F.round("similarity", 5).alias("similarity"))


def _own_distance(spark, sf_dir):
    scored, classes = _scored(spark, sf_dir)
    at = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("label")).cast("int")
    return scored.select("vec_id", "label", (1 - F.element_at("scores", at)).alias("distance"))


def delta_p95(spark, sf_dir):
    """95th percentile of the distances to the own class mean, per class."""
    own = _own_distance(spark, sf_dir).withColumn("distance", F.greatest("distance", F.lit(0.0)))
    return percentile(own, "distance", 0.95, ["label"], top=2.0).select("label", "n", F.round("percentile", 5).alias("delta"))


def decisions(spark, sf_dir):
    """What is decided automatically, reviewed, or too far from every class."""
    p, _ = _predictions(spark, sf_dir)
    p = p.withColumn("distance", 1 - F.array_max("scores"))
    # A single figure.
    found = percentile(p.select(F.greatest("distance", F.lit(0.0)).alias("distance")), "distance", 0.95, top=2.0).first()
    delta = found["percentile"] or 0.0
    d = evaluate.decide(p, "distance", delta, 0.5, "SONSTIGES")
    return d.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum(evaluate.correct()).alias("right"))


def temperature_grid(spark, sf_dir):
    scored, classes = _scored(spark, sf_dir)
    return evaluate.temperature_grid(scored, classes, GRID).select("t", F.round("nll", 6).alias("nll"))


def best_temperature(spark, sf_dir):
    return temperature_grid(spark, sf_dir).agg(F.min_by("t", F.struct("nll", "t")).alias("t"), F.min("nll").alias("nll"))


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_predictions(spark, sf_dir)[0])


def class_f1(spark, sf_dir):
    return evaluate.per_class(_predictions(spark, sf_dir)[0])


def macro_f1(spark, sf_dir):
    return class_f1(spark, sf_dir).agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("f1"), 5).alias("macro_f1"))


def reliability_table(spark, sf_dir):
    r = evaluate.reliability(_predictions(spark, sf_dir)[0])
    return r.select("bin", "n", F.round("confidence", 5).alias("confidence"), F.round("accuracy", 5).alias("accuracy"))


def expected_calibration_error(spark, sf_dir):
    return evaluate.ece(_predictions(spark, sf_dir)[0]).select("rows", F.round("ece", 5).alias("ece"))


def brier_nll(spark, sf_dir):
    p, classes = _predictions(spark, sf_dir)
    return evaluate.brier_nll(p, classes).select("rows", F.round("brier", 5).alias("brier"), F.round("nll", 5).alias("nll"))


def coverage_at_precision(spark, sf_dir):
    return evaluate.coverage_at(_predictions(spark, sf_dir)[0], TARGET)


def risk_coverage_area(spark, sf_dir):
    return evaluate.aurc(_predictions(spark, sf_dir)[0]).select("rows", F.round("aurc", 5).alias("aurc"))


def confidence_auroc(spark, sf_dir):
    return evaluate.auroc(_predictions(spark, sf_dir)[0]).select("rows", F.round("auroc", 5).alias("auroc"))


def mcnemar_test(spark, sf_dir):
    """Means by cosine against means by Euclidean distance."""
    return evaluate.mcnemar(_predictions(spark, sf_dir)[0], _predictions(spark, sf_dir, "euclid")[0], "vec_id")


def bootstrap_interval(spark, sf_dir):
    return evaluate.bootstrap_accuracy(_predictions(spark, sf_dir)[0], "vec_id")


def _figures(spark, sf_dir, metric: str) -> dict:
    """All figures of one model, from predictions that are made once."""
    p, classes = _predictions(spark, sf_dir, metric)
    return evaluate.metrics(materialize(p.select("label", "predicted", "confidence", "probabilities"), "predictions"), classes)


def promotion_gate(spark, sf_dir):
    """Every check of the gate for the Euclidean model against the one by cosine."""
    gate = evaluate.promotion_gate(_figures(spark, sf_dir, "euclid"), _figures(spark, sf_dir, "cosine"))
    return spark.createDataFrame(sorted((k, bool(v)) for k, v in gate.items()), "check string, passed boolean")


def run_register(spark, sf_dir):
    """The register of runs after two models were entered, rejected ones included; class figures are JSON in the table, here their number and the lowest."""
    folder, old = shared_path(spark, "register"), None
    for metric in ("cosine", "euclid"):
        m = _figures(spark, sf_dir, metric)
        promoted = old is None or evaluate.promotion_gate(m, old)["promoted"]
        evaluate.enter(spark, folder, metric, m, promoted)
        old = m if promoted else old
    f1 = F.map_values(F.from_json("per_class_f1", "map<string,double>"))
    figures = [F.round(c, 4).alias(c) for c in ("macro_f1", "ece", "aurc", "auroc", "brier", "coverage")]
    return evaluate.runs(spark, folder).select("run_id", "model_type", *figures, "promoted", F.size(f1).cast("bigint").alias("classes"), F.round(F.array_min(f1), 4).alias("lowest_f1"))


def correction_queue(spark, sf_dir):
    """Head of the review queue: the neighbours of every fiftieth row whose class was corrected, the nearest first; no row twice."""
    p, _ = _predictions(spark, sf_dir)
    df = _emb(spark, sf_dir)
    wrong = df.join(p.where("vec_id % 50 = 0 and label <> predicted").select("vec_id"), "vec_id", "left_semi")
    near = vectors.nearest(wrong, df, 5).select("query", "neighbour", F.round("similarity", 5).alias("similarity"))
    fresh = near.join(wrong.select(F.col("vec_id").alias("neighbour")), "neighbour", "left_anti")
    return fresh.groupBy(F.col("neighbour").alias("vec_id")).agg(F.max("similarity").alias("similarity"))


def macro_f1_residual(spark, sf_dir):
    """Macro-F1 of the classes proper, with the residual class (label 0 here) apart: its precision and recall."""
    rows = class_f1(spark, sf_dir)
    rest = F.col("label") == 0
    # Six places as decimals: the sum is exact, so a mean at half a place is rounded the same way in any order of the rows.
    mean = F.round(F.avg(F.when(~rest, F.col("f1").cast("decimal(7,6)"))), 5).cast("double")
    return rows.agg(F.count_if(~rest).alias("classes"), mean.alias("macro_f1"), F.max(F.when(rest, F.col("precision"))).alias("residual_precision"), F.max(F.when(rest, F.col("recall"))).alias("residual_recall"))


def uncertainty_queue(spark, sf_dir):
    """The 200 smallest margins outside the gold share."""
    p, _ = _predictions(spark, sf_dir)
    q = p.select("vec_id", F.round("margin", 6).alias("margin"), _unit("vec_id").alias("u")).where("u >= 0.2")
    return q.orderBy("margin", "vec_id").limit(200).select("vec_id", "margin")


def random_admixture(spark, sf_dir):
    """A tenth of a queue of 200, drawn at random but the same every time."""
    return _emb(spark, sf_dir).select("vec_id", F.md5(F.concat(F.lit("mix:"), F.col("vec_id").cast("string"))).alias("h")).orderBy("h").limit(20).select("vec_id")


def spot_check(spark, sf_dir):
    """Twenty confident predictions for a look."""
    p, _ = _predictions(spark, sf_dir)
    return p.where("confidence > 0.5").select("vec_id", "predicted", F.md5(F.concat(F.lit("spot:"), F.col("vec_id").cast("string"))).alias("h")).orderBy("h").limit(20).select("vec_id", "predicted")


def stratified_folds(spark, sf_dir):
    """Five folds, alike in classes: rows of a class are numbered in a hashed order."""
    e = _emb(spark, sf_dir).select("vec_id", "label", _unit("vec_id").alias("u"))
    n = running(e, "u", {"n": F.lit(1)}, ["label"], descending=False, ties=False, order=["vec_id"])
    return n.select("vec_id", "label", ((F.col("n") - 1) % 5).cast("bigint").alias("fold"))


def yield_split(spark, sf_dir):
    """Reviewed rows: of each class every fifth for calibration, the rest for training."""
    f = stratified_folds(spark, sf_dir)
    return f.groupBy("label", F.when(F.col("fold") == 0, "calib").otherwise("train").alias("use")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(spark, sf_dir):
    """Balanced weights ``N / (K n)``."""
    n = _emb(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per class
    return n.select("label", "n", F.round(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")), 6).alias("weight"))


def _features(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    return _emb(spark, sf_dir).select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def logistic_regression(spark, sf_dir):
    """Multinomial regression with balanced weights; accuracy on the rows held out by hash."""
    from pyspark.ml.classification import LogisticRegression

    d = _features(spark, sf_dir).withColumn("u", _unit("vec_id"))
    w = class_weights(spark, sf_dir).select(F.col("label").cast("double").alias("label"), "weight")
    train = d.where("u >= 0.2").join(w, "label")
    model = LogisticRegression(family="multinomial", weightCol="weight", maxIter=30, regParam=0.01).fit(train)
    return model.transform(d.where("u < 0.2")).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def linear_svm(spark, sf_dir):
    """One linear support vector machine per class, on the same rows."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    d = _features(spark, sf_dir).withColumn("u", _unit("vec_id"))
    model = OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.01)).fit(d.where("u >= 0.2"))
    return model.transform(d.where("u < 0.2")).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def isotonic_calibration(spark, sf_dir):
    """Confidence mapped monotonously to accuracy: the steps of the map."""
    from pyspark.ml.regression import IsotonicRegression

    p, _ = _predictions(spark, sf_dir)
    d = p.select(F.round("confidence", 4).alias("features"), evaluate.correct().cast("double").alias("label"))
    m = IsotonicRegression().fit(d)
    steps = list(zip(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()))
    return spark.createDataFrame(steps, "confidence double, accuracy double")


def isotonic_classes(spark, sf_dir):
    """Per class the steps of the map from its probability to the share that is of it."""
    p, classes = _predictions(spark, sf_dir)
    return evaluate.isotonic_per_class(p, classes).select("class", "from_p", "n", F.round("calibrated", 6).alias("calibrated"))


def kmeans_diversity(spark, sf_dir):
    """Of each of 25 clusters the vector with the smallest margin."""
    from pyspark.ml.clustering import KMeans

    d = _features(spark, sf_dir)
    c = KMeans(k=25, seed=7, maxIter=10).fit(d).transform(d).select("vec_id", F.col("prediction").alias("cluster"))
    p, _ = _predictions(spark, sf_dir)
    return c.join(p.select("vec_id", "margin"), "vec_id").groupBy("cluster").agg(F.min_by("vec_id", F.struct("margin", "vec_id")).alias("vec_id"), F.min("margin").alias("margin"))


def svd_variance(spark, sf_dir):
    """Share of variance of the sixteen strongest directions of the embeddings."""
    from pyspark.ml.feature import PCA

    m = PCA(k=16, inputCol="features", outputCol="pca").fit(_features(spark, sf_dir))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.explainedVariance.toArray())], "component bigint, share double")


def learning_curve(spark, sf_dir, rounds: int = 20, seeds: int = 5, step: int = 25, start: int = 5):
    """Macro-F1, calibration error and coverage as labels grow: chosen by the model so far and at random, median and quartiles over seeds.

    See ``operators.learning``. Round 0 is the start set, the same for both arms of a seed.
    """
    e = _emb(spark, sf_dir).where("vec_id is not null and label is not null and embedding is not null").withColumn("u", _unit("vec_id"))
    pool, held = materialize(e.where("u >= 0.2").drop("u"), "pool"), materialize(e.where("u < 0.2").drop("u"), "held-out")
    classes = [r[0] for r in e.select("label").distinct().orderBy("label").limit(vectors.MAX_CLASSES + 1).collect()]
    if len(classes) > vectors.MAX_CLASSES:
        raise ValueError("more classes than class means may be sent to the executors for")
    models = learning.arms(pool, classes, rounds, seeds, step, start, GRID)
    names = spark.createDataFrame([(i, m["arm"], m["round"], len(m["ids"])) for i, m in enumerate(models)], "m bigint, arm string, round bigint, labels bigint")
    figures = ("macro_f1", "ece", "coverage")
    got = learning.evaluated(held, models, classes, CURVE_TARGET) if models else spark.createDataFrame([], "m bigint, macro_f1 double, ece double, coverage double")
    quartiles = [F.round(F.percentile(c, F.lit(x)), 6).alias(c + end) for c in figures for end, x in (("", 0.5), ("_low", 0.25), ("_high", 0.75))]
    return got.join(names, "m").groupBy("arm", "round").agg(F.min("labels").alias("labels"), *quartiles)


def learning_curve_readings(spark, sf_dir):
    """By Macro-F1: mean distance of the arms, labels each needs for the level of the active arm at 150 labels, and
    from how many labels on no round gains more than its interquartile range (null if the last round still does)."""
    c = materialize(learning_curve(spark, sf_dir), "curve")
    p = c.groupBy("round").agg(F.min("labels").alias("labels"), *(F.max(F.when(F.col("arm") == a, F.col("macro_f1"))).alias(a) for a in ("active", "random")))
    # The round of 150 labels, or the last: one row.
    at = p.orderBy(F.when(F.col("labels") >= SAVING_AT, F.col("labels")).otherwise(F.lit(1 << 40) - F.col("labels")), "round").limit(1).select(F.col("active").alias("level"), F.col("labels").alias("active_labels"))
    reached = p.join(F.broadcast(at), F.col("random") >= F.col("level")).agg(F.min(p["labels"]).alias("random_labels"))
    w = Window.partitionBy("arm").orderBy("round")  # one row per round
    gain = c.withColumn("gain", F.col("macro_f1") - F.lag("macro_f1").over(w)).withColumn("last", F.lead("round").over(w).isNull())
    open_ = F.col("gain") > F.col("macro_f1_high") - F.col("macro_f1_low")
    still = gain.groupBy("arm").agg(F.max(F.when(open_ | (F.col("round") == 0), F.col("labels"))).alias("labels"), F.bool_or(open_ & F.col("last")).alias("open"))
    level = still.select("arm", F.when(~F.coalesce("open", F.lit(False)), F.col("labels")).alias("labels"))
    saturation = level.agg(*(F.max(F.when(F.col("arm") == a, F.col("labels"))).alias(f"{a}_saturation") for a in ("active", "random")))
    area = p.agg(F.round(F.avg(F.col("active") - F.col("random")), 6).alias("area_between"))
    out = area.join(at, how="left").join(reached, how="left").join(saturation, how="left")
    return out.select("area_between", F.round("level", 6).alias("level"), "active_labels", "random_labels", F.round(F.col("random_labels") / F.col("active_labels"), 6).alias("label_saving"), "active_saturation", "random_saturation")


QUERIES = {
    f.__name__: f
    for f in (nearest_centroid, knn_ood, nearest_neighbours, delta_p95, decisions, temperature_grid, best_temperature, confusion_matrix, class_f1, macro_f1, reliability_table, expected_calibration_error, brier_nll, coverage_at_precision, risk_coverage_area, confidence_auroc, mcnemar_test, bootstrap_interval, promotion_gate, run_register, correction_queue, macro_f1_residual, uncertainty_queue, random_admixture, spot_check, stratified_folds, yield_split, class_weights, logistic_regression, linear_svm, isotonic_calibration, isotonic_classes, kmeans_diversity, svd_variance, learning_curve, learning_curve_readings)
}


def _score_sql(euclid: bool = False) -> str:
    score = "-sum((x - m) * (x - m))" if euclid else "sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)))"
    return f"""e as (select vec_id, label, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings),
c as (select label as k, i, avg(x) as m from e group by 1, 2), s as (select vec_id, e.label as label, k, {score} as s from e join c on e.i = c.i group by vec_id, e.label, k)"""


_PRED = f"""{_score_sql()}, top as (select vec_id, max(s) as t from s group by 1), x as (select s.vec_id as vec_id, label, k, s, exp((s - t) / {TEMPERATURE}) as x from s join top on s.vec_id = top.vec_id),
z as (select vec_id, sum(x) as z from x group by 1), pr as (select x.vec_id as vec_id, label, k, s, x / z as p, row_number() over (partition by x.vec_id order by s desc, k) as r from x join z on x.vec_id = z.vec_id),
pred as (select vec_id, label, max(case when r = 1 then k end) as predicted, max(case when r = 1 then p end) as confidence, max(case when r = 1 then p end) - coalesce(max(case when r = 2 then p end), 0) as margin, -sum(case when p > 0 then p * ln(p) else 0 end) as entropy, max(case when r = 1 then s end) as best from pr group by 1, 2)"""
_CURVE = """g as (select round(confidence, 6) as confidence, count(*) as n, count(*) filter (where label = predicted) as ok from pred group by 1), cv as (select confidence, n, ok, sum(n) over (order by confidence desc) as covered, sum(ok) over (order by confidence desc) as right_ from g)"""
_U = "('0x' || substr(md5(cast(vec_id as varchar)), 1, 13))::bigint / 4503599627370496.0"
_FOLD = f"f as (select vec_id, label, (row_number() over (partition by label order by {_U}, vec_id) - 1) % 5 as fold from embeddings)"
_PAIRS = """e as (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings), nrm as (select vec_id, sqrt(sum(x * x)) as n from e group by 1),
d as (select q.vec_id as q, b.vec_id as b, sum(q.x * b.x) as d from e q join e b on q.i = b.i where q.vec_id % 50 = 0 and b.vec_id <> q.vec_id group by 1, 2),
rk as (select q, b, round(d / (x.n * y.n), 9) as s, row_number() over (partition by q order by round(d / (x.n * y.n), 9) desc, b) as r from d join nrm x on x.vec_id = q join nrm y on y.vec_id = b)"""



def _model_sql(name: str, euclid: bool) -> str:
    """CTEs of one model: ``name_pred`` and the figures of a run in ``name_m`` (one row) and ``name_f`` (one row per class)."""
    n = name
    score = _score_sql(euclid).replace("e as (", f"{n}_e as (").replace("c as (select label", f"{n}_c as (select label").replace(" from e group by 1, 2), s as (select vec_id, e.label", f" from {n}_e e group by 1, 2), {n}_s as (select vec_id, e.label").replace("from e join c on", f"from {n}_e e join {n}_c c on")
    return f"""{score}, {n}_top as (select vec_id, max(s) as t from {n}_s group by 1), {n}_x as (select s.vec_id as vec_id, label, k, s, exp((s - t) / {TEMPERATURE}) as x from {n}_s s join {n}_top top on s.vec_id = top.vec_id),
{n}_z as (select vec_id, sum(x) as z from {n}_x group by 1), {n}_pr as (select x.vec_id as vec_id, label, k, x / z as p, row_number() over (partition by x.vec_id order by s desc, k) as r from {n}_x x join {n}_z z on x.vec_id = z.vec_id),
{n}_pred as (select vec_id, label, max(case when r = 1 then k end) as predicted, max(case when r = 1 then p end) as confidence, sum((p - case when k = label then 1 else 0 end) * (p - case when k = label then 1 else 0 end)) as b from {n}_pr group by 1, 2),
{n}_k as (select label as k from {n}_pred union select predicted from {n}_pred), {n}_f as (select k, round(2 * count(*) filter (where label = k and predicted = k) / cast(count(*) filter (where label = k) + count(*) filter (where predicted = k) as double), 6) as f1 from {n}_pred, {n}_k group by 1),
{n}_bin as (select least(floor(confidence * 10), 9) as b, count(*) as n, avg(confidence) as c, avg(case when label = predicted then 1.0 else 0.0 end) as a from {n}_pred group by 1),
{n}_g as (select round(confidence, 6) as confidence, count(*) as n, count(*) filter (where label = predicted) as ok from {n}_pred group by 1), {n}_cv as (select confidence, n, ok, sum(n) over (order by confidence desc) as covered, sum(ok) over (order by confidence desc) as right_ from {n}_g),
{n}_m as (select (select avg(f1) from {n}_f) as macro_f1, (select sum(n * abs(c - a)) / sum(n) from {n}_bin) as ece, (select avg(b) from {n}_pred) as brier,
(select max(case when right_ / cast(covered as double) >= 0.98 then covered end) / cast(sum(n) as double) from {n}_cv) as coverage, (select sum(n * (1 - right_ / cast(covered as double))) / sum(n) from {n}_cv) as aurc,
(select 1 - sum(ok * (covered - right_ - (n - ok) + (n - ok) / 2.0)) / (sum(ok) * (sum(n) - sum(ok))) from {n}_cv) as auroc)"""


_GATE = f"""with {_model_sql("o", False)}, {_model_sql("n", True)},
checks as (select n_m.macro_f1 >= o_m.macro_f1 - 0.01 as macro_f1, round(n_m.ece, 6) <= round(o_m.ece, 6) + 0.01 as ece, coalesce(round(n_m.coverage, 6), 0) >= coalesce(round(o_m.coverage, 6), 0) as coverage,
not exists (select 1 from o_f left join n_f on o_f.k = n_f.k where coalesce(n_f.f1, 0) < o_f.f1 - 0.05) as class_f1 from n_m, o_m),
gate as (select *, macro_f1 and ece and coverage and class_f1 as promoted from checks)"""

ORACLE = {
    "mcnemar_test": f"""with {_model_sql("o", False)}, {_model_sql("n", True)}, j as (select o_pred.label = o_pred.predicted as a, n_pred.label = n_pred.predicted as b from o_pred join n_pred on o_pred.vec_id = n_pred.vec_id),
d as (select count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b from j)
select only_a, only_b, round(case when only_a + only_b > 0 then pow(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b) else 0.0 end, 6) as statistic from d""",
    "promotion_gate": f"{_GATE} select 'macro_f1' as \"check\", macro_f1 as passed from gate union all select 'ece', ece from gate union all select 'coverage', coverage from gate union all select 'class_f1', class_f1 from gate union all select 'promoted', promoted from gate",
    "run_register": _GATE + "".join(
        f" {'union all' if i else ''} select {i + 1}::bigint as run_id, '{metric}' as model_type, round(macro_f1, 4) as macro_f1, round(ece, 4) as ece, round(aurc, 4) as aurc, round(auroc, 4) as auroc, round(brier, 4) as brier, round(coverage, 4) as coverage, {promoted} as promoted, (select count(*) from {n}_f) as classes, (select round(min(f1), 4) from {n}_f) as lowest_f1 from {n}_m"
        for i, (n, metric, promoted) in enumerate((("o", "cosine", "true"), ("n", "euclid", "(select promoted from gate)")))
    ),
    "correction_queue": f"""with {_PRED}, w as (select vec_id from pred where vec_id % 50 = 0 and label <> predicted), pe as (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings), nrm as (select vec_id, sqrt(sum(x * x)) as n from pe group by 1),
d as (select q.vec_id as q, b.vec_id as b, sum(q.x * b.x) as d from pe q join pe b on q.i = b.i where q.vec_id in (select vec_id from w) and b.vec_id <> q.vec_id group by 1, 2),
rk as (select q, b, round(d / (x.n * y.n), 9) as s, row_number() over (partition by q order by round(d / (x.n * y.n), 9) desc, b) as r from d join nrm x on x.vec_id = q join nrm y on y.vec_id = b)
select b as vec_id, max(round(s, 5)) as similarity from rk where r <= 5 and b not in (select vec_id from w) group by 1""",
    "macro_f1_residual": f"""with {_PRED}, k as (select label as k from pred union select predicted from pred), m as (select k, count(*) filter (where label = k) as support, count(*) filter (where predicted = k) as said, count(*) filter (where label = k and predicted = k) as hit from pred, k group by 1),
f as (select k, round(case when said > 0 then hit / cast(said as double) else 0 end, 6) as p, round(case when support > 0 then hit / cast(support as double) else 0 end, 6) as r, round(2 * hit / cast(support + said as double), 6) as f1 from m)
select count(*) filter (where k <> 0) as classes, round(avg(case when k <> 0 then f1 end), 5) as macro_f1, max(case when k = 0 then p end) as residual_precision, max(case when k = 0 then r end) as residual_recall from f""",
    "nearest_centroid": f"with {_PRED} select vec_id, label, predicted, round(confidence, 6) as confidence, round(margin, 6) as margin, round(entropy, 6) as entropy from pred",
    "knn_ood": f"""with {_PAIRS}, m as (select q, e.i as i, avg(e.x) as m from rk join e on e.vec_id = rk.b where r <= 10 group by 1, 2)
select q as vec_id, round(1 - sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 5) as distance from m join e on e.vec_id = q and e.i = m.i group by 1""",
    "nearest_neighbours": f'with {_PAIRS} select q as query, b as neighbour, r as "rank", round(s, 5) as similarity from rk where r <= 5',
    "delta_p95": f"with {_score_sql()} select label, count(*) as n, round(quantile_cont(1 - s, 0.95), 5) as delta from s where label = k group by 1",
    "decisions": f"""with {_PRED}, d as (select quantile_cont(1 - best, 0.95) as delta from pred), r as (select case when 1 - best > delta then 'SONSTIGES' when confidence >= 0.5 then 'AUTO' else 'REVIEW' end as decision, label = predicted as ok from pred, d)
select decision, count(*) as n, count(*) filter (where ok) as "right" from r group by 1""",
    "temperature_grid": f"""with {_score_sql()}, t as (select cast(unnest({GRID}) as double) as t), z as (select t, vec_id, ln(sum(exp(s / t))) as z from s, t group by 1, 2) select z.t as t, round(avg(z - s / z.t), 6) as nll from z join s on s.vec_id = z.vec_id and s.label = s.k group by 1""",
    "best_temperature": f"""with {_score_sql()}, t as (select cast(unnest({GRID}) as double) as t), z as (select t, vec_id, ln(sum(exp(s / t))) as z from s, t group by 1, 2), n as (select z.t as t, round(avg(z - s / z.t), 6) as nll from z join s on s.vec_id = z.vec_id and s.label = s.k group by 1)
select t, nll from n order by nll, t limit 1""",
    "confusion_matrix": f"with {_PRED} select label, predicted, count(*) as n from pred group by 1, 2",
    "class_f1": f"""with {_PRED}, k as (select label as k from pred union select predicted from pred), m as (select k, count(*) filter (where label = k) as support, count(*) filter (where predicted = k) as said, count(*) filter (where label = k and predicted = k) as hit from pred, k group by 1)
select k as label, support, round(case when said > 0 then hit / cast(said as double) else 0 end, 6) as precision, round(case when support > 0 then hit / cast(support as double) else 0 end, 6) as recall, round(2 * hit / cast(support + said as double), 6) as f1 from m""",
    "macro_f1": f"""with {_PRED}, k as (select label as k from pred union select predicted from pred), m as (select k, round(2 * count(*) filter (where label = k and predicted = k) / cast(count(*) filter (where label = k) + count(*) filter (where predicted = k) as double), 6) as f1 from pred, k group by 1)
select count(*) as classes, round(avg(f1), 5) as macro_f1 from m""",
    "reliability_table": f"with {_PRED} select cast(least(floor(confidence * 10), 9) as bigint) as bin, count(*) as n, round(avg(confidence), 5) as confidence, round(avg(case when label = predicted then 1.0 else 0.0 end), 5) as accuracy from pred group by 1",
    "expected_calibration_error": f"""with {_PRED}, b as (select least(floor(confidence * 10), 9) as b, count(*) as n, avg(confidence) as c, avg(case when label = predicted then 1.0 else 0.0 end) as a from pred group by 1)
select cast(sum(n) as bigint) as rows, round(sum(n * abs(c - a)) / sum(n), 5) as ece from b""",
    "brier_nll": f"""with {_PRED}, r as (select vec_id, sum((p - case when k = label then 1 else 0 end) * (p - case when k = label then 1 else 0 end)) as b, -ln(max(case when k = label then p end)) as n from pr group by 1)
select count(*) as rows, round(avg(b), 5) as brier, round(avg(n), 5) as nll from r""",
    "coverage_at_precision": f"""with {_PRED}, {_CURVE}, q as (select confidence, covered, right_ / cast(covered as double) as pr_ from cv), bad as (select max(confidence) as m from q where pr_ < {TARGET}), t as (select sum(n) as t from g)
select min(case when m is null or confidence > m then confidence end) as tau, round(max(case when pr_ >= {TARGET} then covered end) / cast(max(t) as double), 6) as coverage from q, bad, t""",
    "risk_coverage_area": f"with {_PRED}, {_CURVE} select cast(sum(n) as bigint) as rows, round(sum(n * (1 - right_ / cast(covered as double))) / sum(n), 5) as aurc from cv",
    "confidence_auroc": f"with {_PRED}, {_CURVE} select cast(sum(n) as bigint) as rows, round(1 - sum(ok * (covered - right_ - (n - ok) + (n - ok) / 2.0)) / (sum(ok) * (sum(n) - sum(ok))), 5) as auroc from cv",
    "uncertainty_queue": f"with {_PRED} select vec_id, round(margin, 6) as margin from pred where {_U} >= 0.2 order by round(margin, 6), vec_id limit 200",
    "random_admixture": "select vec_id from embeddings order by md5('mix:' || cast(vec_id as varchar)) limit 20",
    "spot_check": f"with {_PRED} select vec_id, predicted from pred where confidence > 0.5 order by md5('spot:' || cast(vec_id as varchar)) limit 20",
    "stratified_folds": f"with {_FOLD} select vec_id, label, fold from f",
    "yield_split": f"with {_FOLD} select label, case when fold = 0 then 'calib' else 'train' end as use, count(*) as n from f group by 1, 2",
    "class_weights": "with n as (select label, count(*) as n from embeddings group by 1), t as (select sum(n) as s, count(*) as k from n) select label, n, round(s / cast(k * n as double), 6) as weight from n, t",
}
