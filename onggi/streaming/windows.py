"""Operators with state on streams. Row-wise operators (noise, normalisation, examples) take a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_accuracy(stream: DataFrame, time: str = "scored_at", window: str = "1 day", late: str = "21 days", gold: str = "gold", pred: str = "pred", by: str = "noise_type") -> DataFrame:
    """Accuracy per window of event time; rows later than the watermark are dropped, repeated deliveries count once.

    State is bounded by the watermark: identifiers and windows older than it are forgotten."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id", "id", by]) if "run_id" in stream.columns else stream.withWatermark(time, late)
    right = (F.col(gold) == F.col(pred)).cast("int")
    return once.groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(right, F.lit(0))).alias("accuracy"))
