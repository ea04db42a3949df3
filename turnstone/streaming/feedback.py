"""Calibration offsets that follow a feedback log as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.operators import calibration
from turnstone.sources.datasets import FEEDBACK


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log's folder as a stream of records."""
    return spark.readStream.schema(FEEDBACK).json(path)


def offsets_stream(records: DataFrame) -> DataFrame:
    """Offsets of all records so far; for a sink in complete mode: six rows of state."""
    return calibration.offsets(records)
