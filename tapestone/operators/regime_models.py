"""The regime fit as a pair of Estimator and Model, for Pipelines and for keeping on disk."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from .regimes import PARAMS, fit_regimes, ordered_by_drift, regime_states


class _RegimeParams(HasInputCols):
    states = Param(Params._dummy(), "states", "number of states", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "rounds of EM at most", TypeConverters.toInt)
    mixtureRounds = Param(Params._dummy(), "mixtureRounds", "rounds of the mixture that the fit starts at", TypeConverters.toInt)
    fullCovariance = Param(Params._dummy(), "fullCovariance", "full covariance matrices, or diagonal ones", TypeConverters.toBoolean)
    leastRows = Param(Params._dummy(), "leastRows", "whole rows that a series needs", TypeConverters.toInt)
    lag = Param(Params._dummy(), "lag", "bars by which a state's stamp lies before its bar", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(states=3, rounds=50, mixtureRounds=20, fullCovariance=True, leastRows=50, lag=0)


class RegimeEstimator(Estimator, _RegimeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits regimes of each ``symbol`` of rows (symbol, bar, ``inputCols``); states stand in rising order of the first column's mean."""

    @keyword_only
    def __init__(self, *, inputCols=None, states=3, rounds=50, mixtureRounds=20, fullCovariance=True, leastRows=50, lag=0) -> None:  # noqa: N803
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RegimeModel:
        of = self.getOrDefault
        params = fit_regimes(dataset, of("inputCols"), of("states"), of("rounds"), least_rows=of("leastRows"), full=of("fullCovariance"), mixture_rounds=of("mixtureRounds"))
        return self._copyValues(RegimeModel(ordered_by_drift(params)))


class RegimeModel(Model, _RegimeParams, MLReadable, MLWritable):
    """``parameters``: a row for each series. ``transform`` adds state, confidence, probs and stamp_bar by the causal filter; columns of these names are replaced."""

    def __init__(self, parameters: DataFrame | None = None) -> None:
        super().__init__()
        self.parameters = parameters

    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = self.getOrDefault
        found = regime_states(dataset, of("inputCols"), self.parameters, of("states"), of("leastRows"), of("lag"))
        added = [c for c in found.columns if c not in ("symbol", "bar")]
        return dataset.drop(*added).join(found, ["symbol", "bar"])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RegimeModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        self.model.parameters.write.parquet(f"{path}/parameters")


class _Reader(MLReader):
    def load(self, path: str) -> RegimeModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = RegimeModel(spark.read.schema(PARAMS).parquet(f"{path}/parameters"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
