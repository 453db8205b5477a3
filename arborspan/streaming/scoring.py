"""Scoring streams: a model's columns are plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.estimators import TreeModel


def score_stream(stream: DataFrame, model: TreeModel) -> DataFrame:
    """Predictions of a streaming DataFrame, row by row."""
    return model.transform(stream)


def windowed_predictions(stream: DataFrame, model: TreeModel, time: str, window: str, late: str) -> DataFrame:
    """Rows by time window and predicted value; rows later than ``late`` are dropped."""
    scored = model.transform(stream).withWatermark(time, late)
    return scored.groupBy(F.window(time, window).alias("window"), "prediction").agg(F.count(F.lit(1)).alias("n"))
