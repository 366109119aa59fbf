"""Scoring models and the causal regime filter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regimes import log_sum, running_products


def fit_scorer(train: DataFrame, features: Sequence[str], label: str = "label") -> PipelineModel:
    """Median imputation, standardisation and logistic regression, all fitted on ``train`` only."""
    filled = [f"{c}_filled" for c in features]
    stages = [Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=0.01)]
    return Pipeline(stages=stages).fit(train)


def score_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "score")


def calibrate(scored: DataFrame, label: str = "label"):
    """Isotonic regression of the label on the score."""
    return IsotonicRegression(featuresCol="score", labelCol=label).fit(scored.select("score", F.col(label).cast("double").alias(label)))


def regime_filter(rows: DataFrame, means: Sequence[float], sigmas: Sequence[float], stay: float = 0.95, value: str = "x", block: int = 256) -> DataFrame:
    """(symbol, bar, state, confidence): the filtered state of a Gaussian hidden Markov model, from rows up to each bar.

    A block is a product of K x K matrices in the log semiring; the products of a series, a row for each block, give each
    block's carry, and blocks are replayed by themselves. A null value leaves the state to the transition alone.
    """
    k = len(means)
    mu, sd = np.array(means), np.array(sigmas)
    trans = np.full((k, k), np.log((1 - stay) / max(k - 1, 1)))
    np.fill_diagonal(trans, np.log(stay))

    def steps(x: np.ndarray) -> np.ndarray:
        density = -0.5 * ((x[:, None] - mu) / sd) ** 2 - np.log(sd)
        return np.where(np.isnan(x)[:, None], 0.0, density)

    def matrices(pdf: pd.DataFrame) -> np.ndarray:
        return running_products(trans[None] + steps(pdf["x"].to_numpy(float))[:, None, :])

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        m = matrices(pdf.sort_values("bar"))[-1]
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "m": [m.ravel().tolist()]})

    def carries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        ahead = running_products(np.array(pdf["m"].tolist()).reshape(-1, k, k))
        start = np.full(k, -np.log(k))
        into = np.concatenate([start[None], log_sum(start[None, :, None] + ahead[:-1], 1)])
        into -= log_sum(into, 1)[:, None]
        return pd.DataFrame({"symbol": pdf["symbol"], "blk": pdf["blk"], "carry": into.tolist()})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        alpha = log_sum(np.array(pdf["carry"].iloc[0])[None, :, None] + matrices(pdf), 1)
        alpha -= log_sum(alpha, 1)[:, None]
        return pd.DataFrame({"symbol": pdf["symbol"], "bar": pdf["bar"], "state": alpha.argmax(1), "confidence": np.exp(alpha.max(1))})

    own = rows.select("symbol", "bar", F.col(value).alias("x"), F.floor(F.col("bar") / block).alias("blk"))
    maps = own.groupBy("symbol", "blk").applyInPandas(products, "symbol string, blk long, m array<double>")
    carry = maps.groupBy("symbol").applyInPandas(carries, "symbol string, blk long, carry array<double>")
    return own.join(carry, ["symbol", "blk"]).groupBy("symbol", "blk").applyInPandas(replay, "symbol string, bar long, state long, confidence double")
