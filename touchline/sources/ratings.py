"""Rating history files: CSV with a header, one row per club and validity interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATING_SCHEMA = "Rank string, Club string, Country string, Level string, Elo double, `From` date, `To` date"


def read_ratings(spark: SparkSession, path: str, schema: str = RATING_SCHEMA) -> DataFrame:
    """Rows with a rating; a missing or unreadable rating drops the row once, here."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.where(F.col("Elo").isNotNull()).select("Club", "Elo", "From", "To")
