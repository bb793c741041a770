"""Sinks: flagged orders, metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.operators.risk import flagged_orders


def export_flagged(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the orders that need review, highest score first."""
    writer = flagged_orders(scored).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric records as JSON lines, stamped with the time of writing."""
    metrics.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").json(path)
