"""`pyspark.ml` surface: the operators as pipeline stages."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import features, reshape


class _Settable(Params):
    """Parameters by name; unknown names are an error."""

    def set_params(self, **values):
        for name, value in values.items():
            if not self.hasParam(name):
                raise ValueError(f"Invalid parameter {name}")
            self._set(**{name: value})
        return self

    def get_params(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}


class MatchReshaper(Transformer, _Settable, DefaultParamsReadable, DefaultParamsWritable):
    """Nested match records -> one row per team and match, with result flags."""

    keep = Param(Params._dummy(), "keep", "columns carried through", TypeConverters.toListString)

    def __init__(self, keep: list[str] | None = None):
        super().__init__()
        self._setDefault(keep=[])
        if keep is not None:
            self._set(keep=keep)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return reshape.team_matches(dataset, self.getOrDefault(self.keep))


class _FeatureParams(_Settable):
    lags = Param(Params._dummy(), "lags", "lag distances", TypeConverters.toListInt)
    rolling_window = Param(Params._dummy(), "rolling_window", "span of means, games of form", TypeConverters.toInt)
    add_win_rates = Param(Params._dummy(), "add_win_rates", "home and away win rates", TypeConverters.toBoolean)
    add_form_streaks = Param(Params._dummy(), "add_form_streaks", "form and streaks", TypeConverters.toBoolean)
    add_rest_days = Param(Params._dummy(), "add_rest_days", "days since the last match", TypeConverters.toBoolean)
    fill_method = Param(Params._dummy(), "fill_method", "ffill, bfill, mean, median or none", TypeConverters.toString)
    tiebreak = Param(Params._dummy(), "tiebreak", "columns ordering rows of equal time", TypeConverters.toListString)

    def _defaults(self):
        self._setDefault(
            lags=[1, 3, 5], rolling_window=5, add_win_rates=True, add_form_streaks=True, add_rest_days=True,
            fill_method="ffill", tiebreak=[],
        )

    def _table(self, dataset: DataFrame, fill_method: str) -> DataFrame:
        options = {p: self.getOrDefault(p) for p in (
            "lags", "rolling_window", "add_win_rates", "add_form_streaks", "add_rest_days", "tiebreak")}
        return features.feature_table(dataset, fill_method=fill_method, **options)


class FeatureExtractor(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Past-only features. Fitting checks the input and, for mean and median, learns the fill values."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self.set_params(**params)

    def _fit(self, dataset: DataFrame) -> FeatureExtractorModel:
        features.validate_features(dataset)
        method = self.getOrDefault(self.fill_method)
        values: dict[str, float] = {}
        if method in ("mean", "median"):
            table = self._table(dataset, "none")
            columns = features.numeric_columns(table, skip=["team"])
            values = {k: float(v) for k, v in features.fill_values(table, columns, method).first().asDict().items() if v is not None}
        model = FeatureExtractorModel()
        model._set(fill_values=values)
        return self._copyValues(model)


class FeatureExtractorModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    fill_values = Param(Params._dummy(), "fill_values", "learnt mean or median per column", TypeConverters.identity)

    def __init__(self):
        super().__init__()
        self._defaults()
        self._setDefault(fill_values={})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        method = self.getOrDefault(self.fill_method)
        if method not in ("mean", "median"):
            return self._table(dataset, method)
        table = self._table(dataset, "none")
        values = {c: v for c, v in self.getOrDefault(self.fill_values).items() if c in table.columns}
        return table.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})

    def get_feature_names_out(self, dataset: DataFrame) -> list[str]:
        """Output columns for an input of this shape; from its column names, nothing runs."""
        options = {p: self.getOrDefault(getattr(self, p)) for p in ("lags", "add_win_rates", "add_form_streaks", "add_rest_days")}
        return features.feature_columns(dataset.columns, **options)
