"""Scoring streams with frozen models.

Trees and Bayes models become projections (see ``TreeModel.transform`` and
``bayes.predict``), which Structured Streaming runs without state.  Running
counts of outcomes are a watermarked, windowed aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(stream: DataFrame, model, pred: str = "pred") -> DataFrame:
    """A stateless projection: works the same on a stream and on a table."""
    return model.transform(stream, pred=pred)


def windowed_counts(scored: DataFrame, event_time: str, pred: str = "pred", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, pred, n) per window of event time; rows later than ``delay`` are dropped once their window is closed."""
    w = scored.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("w"), F.col(pred))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), pred, "n")
