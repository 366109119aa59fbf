"""Full-covariance regimes: one round against the textbook, states that only a correlation tells apart, and the fit on disk and in a Pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tapestone.operators import regimes
from tapestone.operators.regime_models import RegimeEstimator, RegimeModel


def _rows(spark, x):
    return spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(x)], "symbol string, bar long, x double, y double")


def _correlated(n=1200, run=60, seed=3):
    """Runs of two states with the same means and variances and correlations of 0.9 and -0.9."""
    draw, at = np.random.default_rng(seed), np.arange(n) // run % 2
    a, b = draw.normal(0, 1, (2, n))
    return np.stack([a, np.where(at == 0, 0.9, -0.9) * a + np.sqrt(1 - 0.81) * b], 1), at


def test_round_with_full_matrices(spark):
    x, _ = _correlated(150, 30)
    df = _rows(spark, x)
    full = [1.0, 0.4, 0.4, 0.8, 1.2, -0.3, -0.3, 0.9]
    params = regimes.initial_parameters(df, ["x", "y"], 2).withColumn("vars", F.array(*map(F.lit, full)))
    p = params.first()
    z = (x - np.array(p["shift"])) / np.array(p["scale"])
    start, trans, mu, cov = np.array(p["start"]), np.array(p["trans"]).reshape(2, 2), np.array(p["means"]).reshape(2, 2), np.array(full).reshape(2, 2, 2)
    dens = np.stack([np.exp(-0.5 * np.einsum("nd,de,ne->n", z - m, np.linalg.inv(c), z - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for m, c in zip(mu, cov, strict=True)], 1)
    alpha, beta = np.zeros((150, 2)), np.ones((150, 2))
    alpha[0] = start * dens[0]
    for t in range(1, 150):
        alpha[t] = alpha[t - 1] @ trans * dens[t]
    for t in range(148, -1, -1):
        beta[t] = trans @ (dens[t + 1] * beta[t + 1])
    like = alpha[-1].sum()
    gamma = alpha * beta / like
    xi = sum(alpha[t][:, None] * trans * dens[t + 1] * beta[t + 1] / like for t in range(149))
    blocks = regimes._blocked(df, ["x", "y"], 16)
    got = regimes.expectation(blocks, params).first()
    outer = np.einsum("nk,nd,ne->kde", gamma, z, z)
    assert np.allclose(got["v"], np.concatenate([gamma[0], xi.ravel(), gamma.sum(0), (gamma.T @ z).ravel(), outer.ravel()]), atol=1e-8)
    made = regimes._maximise(1e-3, True)(got["v"], 2, 2)
    means = gamma.T @ z / gamma.sum(0)[:, None]
    spread = [np.einsum("n,nd,ne->de", g, z - m, z - m) / g.sum() + 1e-3 * np.eye(2) for g, m in zip(gamma.T, means, strict=True)]
    assert np.allclose(made["means"], means.ravel()) and np.allclose(made["vars"], np.ravel(spread), atol=1e-8)
    # the mixture's round, without order
    joint = dens * start
    resp = joint / joint.sum(1, keepdims=True)
    want = np.concatenate([resp.sum(0), (resp.T @ z).ravel(), np.einsum("nk,nd,ne->kde", resp, z, z).ravel(), [np.log(joint.sum(1)).sum()]])
    assert np.allclose(regimes.mixture_expectation(blocks, params).first()["v"], want, atol=1e-8)


def test_states_of_one_mean_and_variance(spark):
    x, at = _correlated()
    df = _rows(spark, x)
    agree = {}
    for full in (True, False):
        params = regimes.fit_regimes(df, ["x", "y"], 2, 12, full=full, mixture_rounds=15)
        states = {r["bar"]: r["state"] for r in regimes.regime_states(df, ["x", "y"], params, 2).collect()}
        same = np.mean([states[i] == at[i] for i in range(len(at))])
        agree[full] = max(same, 1 - same)
    assert agree[True] > 0.93 and agree[False] < 0.75


def test_fit_is_an_estimator(spark, tmp_path):
    x, at = _correlated(600)
    df = _rows(spark, x + at[:, None]).withColumn("state", F.lit("kept out"))
    estimator = RegimeEstimator(inputCols=["x", "y"], states=2, rounds=3, mixtureRounds=2, lag=1)
    told = lambda out: sorted((r["bar"], r["state"], round(r["confidence"], 9), r["stamp_bar"]) for r in out.collect())
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    again = RegimeEstimator.load(str(tmp_path / "estimator"))
    assert again.getOrDefault("states") == 2 and again.getInputCols() == ["x", "y"]
    model = again.fit(df)
    want = told(model.transform(df))
    assert len(want) == 600 and {s for _, s, _, _ in want} == {0, 1} and want[5][3] == 4
    model.save(str(tmp_path / "model"))
    assert told(RegimeModel.load(str(tmp_path / "model")).transform(df)) == want
    fitted = Pipeline(stages=[estimator]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "pipeline"))
    assert told(PipelineModel.load(str(tmp_path / "pipeline")).transform(df)) == want
