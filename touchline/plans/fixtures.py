"""Match-shaped views over the given tables. Integer arithmetic only, so results are exact.

Expected goals are whole hundredths (`*_c`); divide once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import reshape, rounds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(customer, cust == F.col("c_custkey")).select(
        key.alias("match_no"),
        F.col("o_orderdate").cast("timestamp").alias("datetime"),
        F.year("o_orderdate").cast("string").alias("season"),
        F.col("c_nationkey").alias("home"),
        ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int").alias("away"),
        ((key * 7 + cust) % 5).cast("int").alias("goals_home"),
        ((key * 3 + cust) % 4).cast("int").alias("goals_away"),
        ((key * 13 + cust) % 301).cast("long").alias("xg_home_c"),
        ((key * 17 + cust) % 251).cast("long").alias("xg_away_c"),
    )


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches in the nested shape of a feed; every fiftieth has no result yet."""
    m = matches(spark, sf_dir)
    played = F.col("match_no") % 50 != 0

    def side(name: str) -> Column:
        return F.struct(
            F.concat(F.lit("NATION "), F.col(name).cast("string")).alias("title"),
            F.concat(F.lit("N"), F.col(name).cast("string")).alias("short_title"),
        )

    def pair(home: str, away: str) -> Column:
        return F.struct(
            F.when(played, F.col(home).cast("string")).alias("h"),
            F.when(played, F.col(away).cast("string")).alias("a"),
        )

    return m.select(
        F.col("match_no").cast("string").alias("id"),
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        side("home").alias("h"),
        side("away").alias("a"),
        pair("goals_home", "goals_away").alias("goals"),
        pair("xg_home_c", "xg_away_c").alias("xG"),
        "season",
    )


def team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshape.to_team_rows(
        matches(spark, sf_dir),
        home="home",
        away="away",
        metrics={"goals": ("goals_home", "goals_away"), "xg_c": ("xg_home_c", "xg_away_c")},
        against={"goals": "goals_against", "xg_c": "xga_c"},
        keep=["match_no", "datetime", "season"],
    )
    return reshape.result_flags(rows)


def rounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.add_rounds(team_rows(spark, sf_dir))


def rounded_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.add_rounds(matches(spark, sf_dir))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating history: at most one row per team and day."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return (
        orders
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("team"), F.col("o_orderdate").cast("timestamp").alias("valid_from"))
        .agg(F.max("o_orderkey").alias("rating"))
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity series: value in whole cents, missing on every seventh event."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        (F.col("event_type") == "purchase").cast("int").alias("win"),
        (F.col("event_type") == "view").cast("int").alias("draw"),
    )


def strength_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of attack, defence and home advantage per (chain, draw, t, team) from the vectors.

    Five time steps; four chains. Elements 1-25 are attack, 26-50 defence, 51-64 home advantage.
    """
    vec = F.col("vec_id")
    base = table(spark, sf_dir, "embeddings").select(
        (vec % 4).cast("int").alias("chain"),
        F.floor(vec / 20).cast("int").alias("draw"),
        (F.floor(vec / 4) % 5).cast("int").alias("t"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    return base.select(
        "chain",
        "draw",
        "t",
        F.explode(F.sequence(F.lit(0), F.lit(24))).alias("team_id"),
        "e",
    ).select(
        "chain",
        "draw",
        "t",
        "team_id",
        F.element_at("e", F.col("team_id") + 1).alias("attack"),
        F.element_at("e", F.col("team_id") + 26).alias("defence"),
        (F.lit(0.25) + F.element_at("e", F.col("team_id") % 14 + 51) * 0.125).alias("home_adv"),
    )


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (season, host, visitor) met in the matches, as a fixture to predict."""
    return (
        matches(spark, sf_dir)
        .groupBy("season", "home", "away")
        .agg(F.count(F.lit(1)).alias("meetings"))
        .select(
            ((F.col("season").cast("int") - 1995) * 10000 + F.col("home") * 100 + F.col("away")).cast("long").alias("match_id"),
            (F.col("season").cast("int") - 1994).alias("round"),
            F.col("home").alias("home_id"),
            F.col("away").alias("away_id"),
        )
    )
