"""Match feed files: nested JSON partitioned by league and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.sources.store import partition_report

CORRUPT = "_corrupt_record"


def _pair(a: str, b: str) -> T.StructType:
    return T.StructType([T.StructField(a, T.StringType()), T.StructField(b, T.StringType())])


RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("h", _pair("title", "short_title")),
        T.StructField("a", _pair("title", "short_title")),
        T.StructField("goals", _pair("h", "a")),
        T.StructField("xG", _pair("h", "a")),
        T.StructField(CORRUPT, T.StringType()),
        T.StructField("league", T.StringType()),
        T.StructField("season", T.StringType()),
    ]
)


def scan_matches(
    spark: SparkSession, path: str, leagues: Sequence[str] | None = None, seasons: Sequence[str] | None = None
) -> DataFrame:
    """All feed rows of the requested partitions, malformed ones included; other partitions are not read."""
    df = (
        spark.read.schema(RAW_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    if leagues:
        df = df.where(F.col("league").isin(*leagues))
    if seasons:
        df = df.where(F.col("season").isin(*[str(s) for s in seasons]))
    return df


def read_matches(
    spark: SparkSession, path: str, leagues: Sequence[str] | None = None, seasons: Sequence[str] | None = None
) -> DataFrame:
    """Well-formed feed rows; an error when the request matches nothing."""
    df = scan_matches(spark, path, leagues, seasons)
    good = df.where(F.col(CORRUPT).isNull() & F.col("datetime").isNotNull()).drop(CORRUPT)
    if good.isEmpty():
        raise ValueError(f"no match data for leagues={leagues} seasons={seasons}")
    return good


def quarantine(spark: SparkSession, path: str, leagues: Sequence[str] | None = None, seasons: Sequence[str] | None = None) -> DataFrame:
    """Rows `read_matches` leaves out, with the raw text of malformed ones."""
    df = scan_matches(spark, path, leagues, seasons)
    return df.where(F.col(CORRUPT).isNotNull() | F.col("datetime").isNull())


def request_report(spark: SparkSession, path: str, leagues: Sequence[str], seasons: Sequence[str]) -> DataFrame:
    """Row count and status of every requested league and season."""
    rows = scan_matches(spark, path, leagues, seasons).where(F.col(CORRUPT).isNull() & F.col("datetime").isNotNull())
    wanted = spark.createDataFrame([(lg, str(s)) for lg in leagues for s in seasons], "league string, season string")
    return partition_report(rows, wanted, ["league", "season"])


def write_matches(df: DataFrame, path: str) -> None:
    """Land feed rows in the layout `scan_matches` prunes; reruns replace only their own partitions."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("league", "season")
        .json(path)
    )
