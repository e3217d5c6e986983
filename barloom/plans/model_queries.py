"""Classifiers on the feature table.

Class models from running sums have exact SQL next to them. Trees and regressions fitted by Spark ML have none.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from barloom.operators import bayes as Y
from barloom.operators import training as J
from barloom.operators.indicators import FEATURES, features
from barloom.operators.series import frame, number_rows
from barloom.plans.registry import epoch, query, rounded
from barloom.plans.score_queries import MODELS, model_probs
from barloom.plans.signal_queries import outcomes
from barloom.plans.sqlparts import BARS, INDICATORS, S, rd, with_
from barloom.session import cut_lineage
from barloom.sources.samples import bars


def _all_rows(spark, sf):
    """Every bar with all features and the label of the next bar (null for the newest), written once."""
    table = features(bars(spark, sf))
    return cut_lineage(frame(table, back=1, ahead=1).then(J.next_bar_label).core("key", "tf_sec", "bar_start", "rn", "label", *FEATURES))


def _rows(spark, sf):
    """Labelled feature rows, written once because every fit reads them."""
    return _all_rows(spark, sf).filter("label IS NOT NULL")


# ---------------------------------------------------------------- models of each series

_LIST = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in FEATURES)
_LABELLED = f""", lab AS (SELECT key, bar_epoch, rn, CAST(lead(close) {S} > lead(open) {S} AS INTEGER) AS label, [{_LIST}] AS xs FROM feat)"""
_BAYES = """,
lx AS (SELECT key, bar_epoch, part, label, unnest(xs) AS x, unnest(range(len(xs))) AS i FROM parts),
ps AS (SELECT DISTINCT key, part FROM parts),
cu AS (SELECT p.key, p.part, i, count(*) FILTER (label = 0)::DOUBLE AS n0, count(*) FILTER (label = 1)::DOUBLE AS n1, avg(x) FILTER (label = 0) AS m0, avg(x) FILTER (label = 1) AS m1,
  var_pop(x) FILTER (label = 0) AS w0, var_pop(x) FILTER (label = 1) AS w1, var_pop(x) AS vt, avg(x) AS mt FROM ps p JOIN lx l ON l.key = p.key AND l.part < p.part AND l.label IS NOT NULL GROUP BY ALL),
mo AS (SELECT key, part, i, n0, n1, m0, m1, greatest(w0, 1e-3::DOUBLE * vt) AS v0, greatest(w1, 1e-3::DOUBLE * vt) AS v1 FROM cu WHERE n0 > 0 AND n1 > 0 AND vt > 1e-20::DOUBLE * mt * mt),
od AS (SELECT key, bar_epoch, max(ln(n1 / n0)) + sum(0.5::DOUBLE * ln(v0 / v1) + (x - m0) ** 2 / (2 * v0) - (x - m1) ** 2 / (2 * v1)) AS odds FROM lx JOIN mo USING (key, part, i) GROUP BY ALL),
nt AS (SELECT p.key, p.part, CAST(coalesce(any_value(n0 + n1), 0) AS BIGINT) AS n_train, coalesce(any_value(n0 > 0 AND n1 > 0), false) AS two FROM ps p LEFT JOIN cu c USING (key, part) GROUP BY ALL),
pr AS (SELECT p.key, p.bar_epoch, p.rn, p.part, p.label, n_train, two AND n_train >= {min_rows} AS trained,
  CASE WHEN two AND n_train >= {min_rows} THEN 1 / (1 + exp(-least(greatest(odds, -500), 500))) ELSE 0.5::DOUBLE END AS prob
  FROM parts p JOIN nt USING (key, part) LEFT JOIN od USING (key, bar_epoch))"""
_FOLDED = (
    with_(BARS, INDICATORS, _LABELLED)
    + """, cn AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lab WHERE label IS NOT NULL),
parts AS (SELECT *, CAST(greatest(0, 5 - (n - rn - 1) // greatest(n // 6, 1)) AS INTEGER) AS part FROM cn)"""
    + _BAYES.format(min_rows=1)
    + """, fa AS (SELECT key, part AS fold, count(*) AS n, avg(CASE WHEN (prob > 0.5::DOUBLE) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pr WHERE part > 0 GROUP BY ALL)"""
)


def _fold_accuracy(rows):
    return Y.fold_accuracy(Y.earlier_probability(J.expanding_folds(rows), FEATURES, "fold"))


@query("series_model_folds", _FOLDED + f" SELECT key, fold, n, {rd('accuracy')} FROM fa")
def series_model_folds(spark, sf):
    """Accuracy of every series' own class model in five expanding folds, on all features."""
    return _fold_accuracy(_rows(spark, sf)).select("key", "fold", "n", *rounded("accuracy"))


@query(
    "series_model_walk_forward",
    with_(BARS, INDICATORS, _LABELLED)
    + ", parts AS (SELECT *, CASE WHEN rn >= 150 THEN (rn - 150) // 20 ELSE -1 END AS part FROM lab)"
    + _BAYES.format(min_rows=150)
    + f" SELECT key, bar_epoch, part AS cohort, n_train, trained, {rd('prob')} FROM pr WHERE part >= 0",
)
def series_model_walk_forward(spark, sf):
    """Probability of a green next bar, by a model retrained every 20 bars on all bars before."""
    rows = J.retrain_cohorts(_all_rows(spark, sf)).withColumn("cohort", F.coalesce("cohort", F.lit(-1)).cast("bigint"))
    scored = Y.earlier_probability(rows, FEATURES, "cohort", min_rows=150)
    return scored.filter("cohort >= 0").select("key", epoch(), "cohort", "n_train", "trained", *rounded("prob"))


@query(
    "series_model_status",
    _FOLDED
    + f""", st AS (SELECT key, c.n AS n_rows, c.n >= 150 AS trained, CASE WHEN c.n >= 150 THEN coalesce(a, 0) ELSE 0 END AS accuracy
  FROM (SELECT key, count(*) AS n FROM parts GROUP BY key) c LEFT JOIN (SELECT key, avg(accuracy) AS a FROM fa GROUP BY key) USING (key))
SELECT key, n_rows, trained, {rd('accuracy')} FROM st""",
)
def series_model_status(spark, sf):
    """Rows, readiness and mean fold accuracy of every series' class model."""
    rows = _rows(spark, sf)
    return Y.series_status(rows, _fold_accuracy(rows)).select("key", "n_rows", "trained", *rounded("accuracy"))


# ---------------------------------------------------------------- Spark ML members


@query("classifier_cross_validation")
def classifier_cross_validation(spark, sf):
    """Test accuracy of the members that need one pass a fit over five expanding folds; `series_model_folds` is per series."""
    chosen = {name: m for name, m in J.members().items() if name in ("tree", "logistic")}
    folded = J.expanding_folds(_rows(spark, sf))
    return J.cross_validate(folded, FEATURES, chosen).select("fold", "model", "n", *rounded("accuracy"))


@query("classifier_members")
def classifier_members(spark, sf):
    """Every member fitted on the first 80 % of each series; accuracy on the rest."""
    split = J.chronological_split(_rows(spark, sf))
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    out = None
    for name, classifier in J.members().items():
        scored = J.fit_member(train, classifier, FEATURES).transform(test)
        part = scored.agg(
            F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")
        ).select(F.lit(name).alias("model"), "n", *rounded("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


@query("calibrated_probability")
def calibrated_probability(spark, sf):
    """Logistic scores and their isotonic calibration, for the newest tenth of each series.

    The classifier is fitted on the first 80 %, the calibration on the tenth after it, so no row is scored by what saw it.
    """
    split = J.chronological_split(_rows(spark, sf))
    rest = J.chronological_split(split.withColumnRenamed("is_train", "_fits"), 0.9).filter("NOT _fits")
    model = J.fit_member(split.filter("is_train"), LogisticRegression(featuresCol="features", labelCol="label"), FEATURES)
    scored = J.probability(model.transform(rest)).select("key", "bar_start", "label", "prob", "is_train")
    held, newest = scored.filter("is_train").select("label", "prob"), scored.filter("NOT is_train").drop("is_train")
    return J.calibrate(held, newest).select("key", epoch(), "label", *rounded("prob", "calibrated"))


@query("stacked_probability")
def stacked_probability(spark, sf):
    """Stacked and fused probability of every bar, the stack fitted on the first 80 % of each series' decided signals.

    `in_sample` tells the bars up to the last one that the stack has seen. Bars with too few decided signals get the mean.
    """
    settled = outcomes(spark, sf).filter("outcome IN ('WIN', 'LOSS')")
    matrix = J.stacking_rows(model_probs(spark, sf), list(MODELS))
    labels = settled.select("key", "tf_sec", "bar_start", (F.col("outcome") == "WIN").cast("int").alias("label"))
    rows = number_rows(cut_lineage(matrix.join(labels, ["key", "bar_start"])))
    seen = J.chronological_split(rows).filter("is_train")
    last = seen.groupBy("key").agg(F.max("bar_start").alias("_last"))
    mean = sum((F.col(m) for m in list(MODELS)[1:]), F.col(list(MODELS)[0])) / len(MODELS)
    scored = J.stacked(seen, matrix, list(MODELS), mean).join(last, "key", "left")
    in_sample = F.coalesce(F.col("bar_start") <= F.col("_last"), F.lit(False))
    return scored.withColumn("fused", J.fuse_stack(mean, F.col("stacked"))).select(
        "key", epoch(), in_sample.alias("in_sample"), *rounded("stacked", "fused")
    )


@query("meta_label")
def meta_label(spark, sf):
    """Probability that the primary signal is right, from all features of its bar.

    Fitted on the first 80 % of each series' decided signals and given for the later ones.
    """
    settled = outcomes(spark, sf).filter("outcome IN ('WIN', 'LOSS')")
    right = settled.select("key", "bar_start", (F.col("outcome") == "WIN").cast("int").alias("label"))
    rows = _rows(spark, sf).drop("label", "rn").join(right, ["key", "bar_start"])
    split = J.chronological_split(number_rows(cut_lineage(rows)))
    scored = J.meta_probability(split.filter("is_train"), split.filter("NOT is_train"), FEATURES)
    return scored.select("key", epoch(), "label", *rounded("meta_prob"))


@query("model_status")
def model_status(spark, sf):
    """Rows, readiness and mean fold accuracy per member over all series; `series_model_status` is per series."""
    rows = _rows(spark, sf)
    folded = J.expanding_folds(rows)
    chosen = {name: m for name, m in J.members().items() if name in ("logistic", "bayes")}
    accuracies = J.cross_validate(folded, FEATURES, chosen)
    return J.model_status(accuracies, rows).select("model", "n_rows", "n_tested", "trained", *rounded("accuracy"))
