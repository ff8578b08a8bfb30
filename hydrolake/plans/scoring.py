"""Depth scores and their assessment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import risk
from hydrolake.functions.numeric import clip
from hydrolake.operators import series
from hydrolake.operators.ensembles import TreeModel
from hydrolake.operators.series import Series
from hydrolake.plans import features

MAX_DEPTH = 300.0


def raw_depth(df: DataFrame, model: TreeModel | None, out: str = "depth_cm") -> DataFrame:
    """Model output per row; without a model the depth formula stands in. Never negative."""
    if model is None:
        return df.withColumn(out, risk.formula_depth("rain_intensity_max", "pasut_msl_max"))
    return model.predict(df, 0, "_raw").withColumn(out, F.greatest(F.lit(0.0), F.col("_raw"))).drop("_raw")


def score_rows(df: DataFrame, model: TreeModel | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Depth (0..300 cm) and full assessment for sparse daily input rows."""
    feats = features.daily_features(df, keep=keep)
    scored = raw_depth(feats, model).withColumn("depth_cm", clip("depth_cm", 0, MAX_DEPTH))
    rain, tide = F.col("rain_sum_imputed"), F.col("pasut_msl_max")
    return scored.withColumns(risk.assessment_columns("depth_cm", rain, tide, "elevation_m"))


def score_series(
    hourly: DataFrame, model: TreeModel | None = None, by: str = "loc", time: str = "time", size: int = series.HOURS_PER_CHUNK, smooth: bool = True
) -> DataFrame:
    """Hourly depth, smoothed over the neighbouring hours, with its status.

    With the formula only the two inputs it reads are built; a fitted model gets all features.
    One shuffle either way: smoothing runs inside the chunks that carry the rolling windows.
    """
    if model is None:
        base = series.hour_index(hourly, time)
        s = Series(base, by, back=24, ahead=1, size=size)
        s.add(
            rain_rolling_24h=s.rolling("precipitation", 24),
            _depth=risk.formula_depth("precipitation", "est"),
        )
    else:
        s, indexed = features.open_hourly(hourly, by, time, size, ahead=1, extra_back=1)
        s = features.add_hourly_features(s, indexed, time)
        s.df = raw_depth(s.df.withColumn("rain_rolling_24h", F.col("rain_sum_imputed")), model, "_depth")
    s.add(depth_cm=s.centered_mean("_depth", 1) if smooth else F.col("_depth"))
    extra = [c for c in ("soil_moisture_surface", "soil_moisture_root") if c in hourly.columns]
    return s.rows().select(
        by, time, "depth_cm", risk.risk_label("depth_cm").alias("status"), "rain_rolling_24h", "est", "precipitation", *extra
    )


def max_depth(scored: DataFrame, by: str = "loc") -> DataFrame:
    return scored.groupBy(by).agg(F.max("depth_cm").alias("max_depth_cm"))
