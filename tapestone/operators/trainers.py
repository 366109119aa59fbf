"""Choosing, calibrating and judging scorers in time order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.folders import saved
from . import groups as grp
from . import models
from . import reports as rep

#: The candidates that a scorer is chosen from.
CANDIDATES: dict[str, Callable[[str], object]] = {
    "logistic": lambda label: LogisticRegression(labelCol=label, regParam=0.01),
    "forest": lambda label: RandomForestClassifier(labelCol=label, numTrees=20, maxDepth=4, seed=42),
    "boosting": lambda label: GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=42),
}


def fit(train: DataFrame, features: Sequence[str], name: str = "logistic", label: str = "label") -> PipelineModel:
    """Medians, standardisation and the candidate ``name``, all fitted on ``train`` only."""
    filled = [f"{c}_filled" for c in features]
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), CANDIDATES[name](label)]
    return Pipeline(stages=stages).fit(train)


def fits(train: DataFrame, least: int = 20, label: str = "label") -> bool:
    """Whether ``train`` has ``least`` rows and both labels."""
    n, kinds = train.agg(F.count(F.lit(1)), F.countDistinct(label)).first()
    return n >= least and kinds > 1


def pr_auc(scored: DataFrame, label: str = "label", score: str = "score") -> float | None:
    row = rep.binary_metrics(scored.withColumn("_all", F.lit(1)), ["_all"], label, score).first()
    return None if row is None else row["pr_auc"]


def best_candidate(split: DataFrame, features: Sequence[str], names: Sequence[str] = tuple(CANDIDATES)) -> tuple[str, PipelineModel, dict[str, float]]:
    """The candidate with the best average precision on the rows of ``split`` val, fitted on those of train; ties go to the first."""
    train, val = saved(split.filter("split = 'train'"), "train"), saved(split.filter("split = 'val'"), "val")
    made = {n: fit(train, features, n) for n in names}
    found = {n: pr_auc(models.score_rows(m, val)) or 0.0 for n, m in made.items()}
    best = max(names, key=lambda n: found[n])
    return best, made[best], found


def calibrated(model: PipelineModel, split: DataFrame) -> DataFrame:
    """The rows of ``split`` test with ``score`` and ``calibrated``: an isotonic map fitted on val alone."""
    val, test = (models.score_rows(model, split.filter(F.col("split") == part)) for part in ("val", "test"))
    return models.calibrate(val).transform(test).withColumnRenamed("prediction", "calibrated")


def walk_forward_metrics(rows: DataFrame, features: Sequence[str], folds: int, order: Sequence[str], keys: Sequence[str], name: str = "logistic") -> DataFrame:
    """(fold, n, positives, roc_auc, pr_auc, brier, ...) of expanding folds; a fold that can't be fitted is left out.

    One fit for each fold: they are few, and each is a distributed job of its own.
    """
    cut, out = saved(grp.expanding_folds(rows, folds, order, keys=keys), "folds"), None
    for f in range(folds):
        part = cut.filter(F.col("fold") == f)
        train = part.filter("role = 'train'")
        if not fits(train):
            continue
        scored = models.score_rows(fit(train, features, name), part.filter("role = 'test'"))
        m = saved(rep.binary_metrics(scored, ["fold"]), "fold-metrics")
        out = m if out is None else out.unionByName(m)
    if out is None:
        raise ValueError("no fold can be fitted")
    return out


def fold_summary(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, mean, std, min, max) over the folds; std is the population's."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("c")
    return metrics.select(cells).groupBy("c.metric").agg(F.avg("c.v").alias("mean"), F.stddev_pop("c.v").alias("std"), F.min("c.v").alias("min"), F.max("c.v").alias("max"))


def gated_result(model: PipelineModel, split: DataFrame, result: str = "result_r") -> DataFrame:
    """(gate, n, pf, expectancy) of the test rows: all, and those that score at least the median score of train."""
    scored = models.score_rows(model, split)
    cut = scored.filter("split = 'train'").agg(F.percentile("score", 0.5).alias("_cut"))
    test = scored.filter("split = 'test'").join(F.broadcast(cut))  # one row
    arms = F.array_compact(F.array(F.lit("all"), F.when(F.col("score") >= F.col("_cut"), "model")))
    x = F.col(result)
    return test.withColumn("gate", F.explode(arms)).groupBy("gate").agg(F.count(x).alias("n"), rep.profit_factor(x).alias("pf"), F.avg(x).alias("expectancy"))


def probabilities(events: DataFrame, features: DataFrame, names: Sequence[str], scorer: Callable[[Sequence[Column]], Column] | PipelineModel, key: str = "event_id") -> DataFrame:
    """``events`` with ``model_prob`` by id: NaN and null features count as 0; an event without a feature row, or whose score is no number in 0..1, has none.

    ``scorer`` is a fitted pipeline, or a function from the feature columns to a column.
    """
    zero = F.lit(0.0)
    whole = features.select(key, *[F.coalesce(F.nanvl(F.col(n).cast("double"), zero), zero).alias(n) for n in names])
    if isinstance(scorer, PipelineModel):
        scored = models.score_rows(scorer, whole).select(key, F.col("score").alias("model_prob"))
    else:
        scored = whole.select(key, scorer([F.col(n) for n in names]).alias("model_prob"))
    ok = F.col("model_prob").between(0.0, 1.0) & ~F.isnan("model_prob")
    return events.join(scored.withColumn("model_prob", F.when(ok, F.col("model_prob"))), key, "left")


def gate_pr_auc(train: DataFrame, oos: DataFrame, features: Sequence[str], fallback: str = "rule_score") -> tuple[float, float, str]:
    """(average precision, base rate, scorer) out of sample: by a logistic scorer fitted on ``train``, or by ``fallback`` where train has under 20 rows or one label; the base rate where ``oos`` has one label."""
    base = oos.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    if not 0 < base < 1:
        return base, base, "none"
    if fits(train):
        return pr_auc(models.score_rows(fit(train, features), oos)), base, "logistic"
    return pr_auc(oos.withColumn("score", F.col(fallback))), base, fallback
