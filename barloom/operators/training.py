"""Training sets, folds, classifiers and probability fusion on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import Framed, Layers


def next_bar_label(f: Framed, ahead: int = 1) -> Layers:
    """`label`: 1 where the bar `ahead` bars later closes above its open; null where it is unknown."""
    later = f.next("close", ahead) > f.next("open", ahead)
    yield {"label": later.cast("int")}


def sequence_windows(f: Framed, names: Sequence[str], length: int = 30) -> Layers:
    """`sequence`: the feature rows of the last `length` bars, oldest first; null before they are there."""
    step = F.array(*[F.col(n).cast("double") for n in names])
    whole = F.count(F.lit(1)).over(f.rows(-(length - 1))) == length
    yield {"_step": step}
    yield {"sequence": F.when(whole, F.collect_list("_step").over(f.rows(-(length - 1))))}


def expanding_folds(rows: DataFrame, folds: int = 5, keys: Sequence[str] = ("key", "tf_sec")) -> DataFrame:
    """Chronological folds per series: fold k is tested on its rows and trained on all earlier ones.

    Rows before the first test range get fold 0 (training only). Needs `rn`, the position among the
    labelled rows of the series.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.floor(F.col("_n") / (folds + 1)), F.lit(1))
    fold = F.greatest(F.lit(0), folds - F.floor((F.col("_n") - F.col("rn") - 1) / size))
    return rows.join(sizes, list(keys)).withColumn("fold", fold.cast("int")).drop("_n")


def chronological_split(rows: DataFrame, share: float = 0.8, keys: Sequence[str] = ("key", "tf_sec")) -> DataFrame:
    """`is_train`: whether the row lies in the first `share` of its series. Needs `rn`."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, list(keys)).withColumn("is_train", F.col("rn") < F.floor(F.col("_n") * share)).drop("_n")


def retrain_cohorts(rows: DataFrame, every: int = 20, warmup: int = 150) -> DataFrame:
    """`cohort`: the number of the model that scores a bar; a new one is due every `every` bars."""
    cohort = F.floor((F.col("rn") - warmup) / every)
    due = (F.col("rn") >= warmup) & ((F.col("rn") + 1) % every == 0)
    return rows.withColumns({"cohort": F.when(F.col("rn") >= warmup, cohort), "retrain_due": due})


def members(seed: int = 42, trees: int = 300, rounds: int = 40, step: float = 0.3) -> dict[str, object]:
    """The six classifiers of the ensemble, each reading the scaled features.

    Boosting rounds follow each other as jobs, so by default there are few with a long step; 400 and 0.03 are the slow way.
    """
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=5, maxMemoryInMB=1024, seed=seed, **common),
        "extra": RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=5, featureSubsetStrategy="onethird", maxMemoryInMB=1024, seed=seed + 1, **common),
        "boosted": GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=step, subsamplingRate=0.8, seed=seed, **common),
        "tree": DecisionTreeClassifier(maxDepth=5, seed=seed, **common),
        "logistic": LogisticRegression(maxIter=50, regParam=0.01, **common),
        "bayes": NaiveBayes(modelType="gaussian", **common),
    }


def fit_member(train: DataFrame, classifier, names: Sequence[str]) -> PipelineModel:
    """Assemble, standardise on the training rows only, and fit one classifier."""
    stages = [
        VectorAssembler(inputCols=list(names), outputCol="raw_features", handleInvalid="skip"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        classifier,
    ]
    return Pipeline(stages=stages).fit(train)


def probability(scored: DataFrame, name: str = "prob") -> DataFrame:
    """Probability of label 1 as a plain column."""
    return scored.withColumn(name, vector_to_array("probability")[1])


def cross_validate(folded: DataFrame, names: Sequence[str], classifiers: dict[str, object], folds: int = 5) -> DataFrame:
    """Test accuracy per fold and member: each fold's model is fitted on all earlier folds.

    The loop runs over folds and members, not over data; every fit and score is a Spark job.
    """
    results = []
    for k in range(1, folds + 1):
        train, test = folded.filter(F.col("fold") < k), folded.filter(F.col("fold") == k)
        for name, classifier in classifiers.items():
            scored = fit_member(train, classifier, names).transform(test)
            right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
            results.append(
                scored.agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy")).select(
                    F.lit(k).alias("fold"), F.lit(name).alias("model"), "n", "accuracy"
                )
            )
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def calibrate(train: DataFrame, scored: DataFrame, column: str = "prob") -> DataFrame:
    """`calibrated`: isotonic regression of the label on the score, fitted on `train`."""
    model = IsotonicRegression(featuresCol=column, labelCol="label", predictionCol="calibrated").fit(
        train.withColumn("label", F.col("label").cast("double"))
    )
    return model.transform(scored)


def fuse(probs: DataFrame, accuracies: DataFrame, floor: float = 0.05, default: float = 0.55) -> DataFrame:
    """Accuracy-weighted mean of the model probabilities per bar; skill below `floor` counts as `floor`.

    `probs` is long: key, bar_start, model, prob. `accuracies`: model, accuracy (few rows).
    """
    skill = F.greatest(F.lit(floor), F.coalesce(F.col("accuracy"), F.lit(default)) - 0.5)
    weighted = probs.join(accuracies, "model", "left").withColumn("_w", skill)
    return weighted.groupBy("key", "bar_start").agg(
        F.round(F.sum(F.col("prob") * F.col("_w")) / F.sum("_w"), 9).alias("base_prob"),
        F.count(F.lit(1)).alias("n_models"),
        F.avg((F.col("prob") < 0.50).cast("double")).alias("oppose_share_green"),
        F.avg((F.col("prob") > 0.50).cast("double")).alias("oppose_share_red"),
    )


def model_agreement(probs: DataFrame) -> DataFrame:
    """Per bar: how many models accept GREEN, their share and mean confidence, and the most decisive model."""
    accepting = F.col("prob") > 0.5
    decisive = F.abs(F.col("prob") - 0.5)
    return probs.groupBy("key", "bar_start").agg(
        F.count_if(accepting).alias("accepting"),
        F.avg(accepting.cast("double")).alias("accept_share"),
        F.avg(F.when(accepting, F.col("prob"))).alias("accept_confidence"),
        F.max_by("model", F.struct(decisive, "model")).alias("most_decisive"),
    )


def stacking_rows(probs: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per bar with the probability of every model as a column."""
    return probs.groupBy("key", "bar_start").pivot("model", list(models)).agg(F.first("prob"))


def stacking_trigger(buffer: DataFrame, min_rows: int = 50, every: int = 25) -> DataFrame:
    """Per key: usable rows (vectors as long as the newest one) and whether a retrain is due.

    `buffer`: key, ts, probs array, label.
    """
    newest = buffer.groupBy("key").agg(F.max_by(F.size("probs"), "ts").alias("width"), F.count(F.lit(1)).alias("n"))
    usable = buffer.join(newest, "key").filter(F.size("probs") == F.col("width"))
    due = (F.col("n") >= min_rows) & (F.col("n") % every == 0)
    return usable.groupBy("key", "n").agg(F.count(F.lit(1)).alias("usable")).withColumn("due", due)


def fit_stack(rows: DataFrame, models: Sequence[str], n_rows: int) -> PipelineModel:
    """Logistic regression over standardised model probabilities, with a penalty of one unit over all rows."""
    regression = LogisticRegression(maxIter=500, regParam=1.0 / max(n_rows, 1), standardization=False, featuresCol="features", labelCol="label")
    return fit_member(rows, regression, models)


def stacked(seen: DataFrame, rows: DataFrame, models: Sequence[str], mean: Column, min_rows: int = 50) -> DataFrame:
    """`stacked` for `rows`, by the stack fitted on `seen`; the mean of the members below `min_rows` rows or one class."""
    found = seen.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes")).first()
    if found["n"] < min_rows or found["classes"] < 2:
        return rows.withColumn("stacked", mean)
    return probability(fit_stack(seen, models, found["n"]).transform(rows), "stacked")


def fuse_stack(base: Column, stacked: Column) -> Column:
    return base * 0.60 + stacked * 0.40


def meta_probability(seen: DataFrame, rows: DataFrame, names: Sequence[str], min_rows: int = 80, default: float = 0.75, seed: int = 42) -> DataFrame:
    """`meta_prob` for `rows`: does a forest fitted on `seen`, classes weighted to balance, hold the signal for right?

    `default` below `min_rows` rows or with one class only.
    """
    found = seen.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("share")).first()
    if found["n"] < min_rows or found["share"] in (0.0, 1.0):
        return rows.withColumn("meta_prob", F.lit(default))
    share = found["share"]
    weighted = seen.withColumn("class_weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    forest = RandomForestClassifier(
        numTrees=200, maxDepth=6, minInstancesPerNode=5, seed=seed, featuresCol="features", labelCol="label", weightCol="class_weight"
    )
    return probability(fit_member(weighted, forest, names).transform(rows), "meta_prob")


def model_status(accuracies: DataFrame, rows: DataFrame, min_rows: int = 150) -> DataFrame:
    """Per model: rows it could train on, whether that is enough, and its mean fold accuracy."""
    per_model = accuracies.groupBy("model").agg(F.avg("accuracy").alias("accuracy"), F.sum("n").alias("n_tested"))
    # One more row tells the size; there are as many rows as models.
    size = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    listed = per_model.unionByName(size, allowMissingColumns=True)
    listed = listed.withColumn("n_rows", F.max("n_rows").over(Window.partitionBy(F.lit(1)))).filter(F.col("model").isNotNull())
    return listed.withColumn("trained", F.col("n_rows") >= min_rows)
