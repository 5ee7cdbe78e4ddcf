"""Season rounds, match identity and the state of the calendar.

Rows are never ranked directly. Weeks are first reduced to one row per (season, week), which the
calendar bounds at 53 per season, and only that table is ranked and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators.cells import Track, running
from touchline.session import small_side


def round_calendar(
    rows: DataFrame, group: Sequence[str] = (), season: str = "season", ts: str = "datetime", mode: str = "week"
) -> DataFrame:
    """One row per (group, season, week) with `round_in_season` and `cum_round`.

    mode="week" ranks calendar weeks. mode="iso_week" follows ISO week numbers relative to the
    season's first week, wrapping by 52, so week 53 and the week after it share a round.
    """
    keys = [*group, season]
    week = S.round_week(F.col(ts))
    if mode == "week":
        weeks = rows.groupBy(*keys, week.alias("week_key")).agg(F.count(F.lit(1)).alias("_n"))
        ranked = weeks
        order = "week_key"
    elif mode == "iso_week":
        number = F.weekofyear(F.col(ts) - F.expr("INTERVAL 1 DAY"))
        weeks = rows.groupBy(*keys, number.alias("week_key")).agg(F.min(ts).alias("_first"))
        first = F.min_by("week_key", F.struct("_first", "week_key")).over(Window.partitionBy(*keys))
        wrapped = F.when(F.col("week_key") < first, F.col("week_key") + 52).otherwise(F.col("week_key"))
        ranked = weeks.withColumn("_order", wrapped - first + 1)
        order = "_order"
    else:
        raise ValueError(f"unknown mode {mode!r}")
    by_week = Window.partitionBy(*keys).orderBy(order)
    ranked = ranked.withColumn("round_in_season", F.dense_rank().over(by_week))
    # Rounds of earlier seasons: count each season's rounds once, in season order.
    starts = Window.partitionBy(*group).orderBy(season, order)
    new = F.when(F.lag("round_in_season").over(by_week).eqNullSafe(F.col("round_in_season")), 0).otherwise(1)
    ranked = ranked.withColumn("_new", new)
    return ranked.withColumn("cum_round", F.sum("_new").over(starts).cast("int")).select(
        *keys, "week_key", "round_in_season", "cum_round"
    )


def add_rounds(
    rows: DataFrame, group: Sequence[str] = (), season: str = "season", ts: str = "datetime", mode: str = "week"
) -> DataFrame:
    """Add `round_in_season`, `cum_round` and `round` (= `cum_round`)."""
    keys = [*group, season]
    calendar = round_calendar(rows, group, season, ts, mode)
    week = S.round_week(F.col(ts)) if mode == "week" else F.weekofyear(F.col(ts) - F.expr("INTERVAL 1 DAY"))
    # At most 53 rows per season; with groups their number is checked before anything is broadcast.
    side = small_side(calendar) if group else F.broadcast(calendar)
    return (
        rows.withColumn("week_key", week)
        .join(side, [*keys, "week_key"], "left")
        .drop("week_key")
        .withColumn("round", F.col("cum_round"))
    )


def season_offsets(rows: DataFrame, season: str = "season", round_column: str = "round_in_season") -> DataFrame:
    """Rounds per season and how many came before it."""
    prior = Window.orderBy(season).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy(season)
        .agg(F.max(round_column).cast("long").alias("rounds"))
        .withColumn("round_offset", F.coalesce(F.sum("rounds").over(prior), F.lit(0)).cast("long"))
    )


def match_ids(rows: DataFrame, ts: str = "datetime", team: str = "team", opp: str = "opp_team") -> DataFrame:
    """Distinct match keys with a dense 0-based id in key order.

    Ids come from `running` over the keys with one cell per day, so the global rank is a local rank
    plus an offset; only days, which the calendar bounds, are scanned in one place. Keys start with the time, so days ascend with them.
    Matches without a time have no id.
    """
    keys = rows.select(F.col(ts).alias("_ts"), S.pair_key(F.col(ts), F.col(team), F.col(opp)).alias("match_key")).distinct()
    track = Track([], "match_key", cell=F.date_trunc("day", F.col("_ts")))
    return running(keys, track, position="_pos").select("match_key", (F.col("_pos") - 1).alias("match_id"))


def add_match_ids(rows: DataFrame, ts: str = "datetime", team: str = "team", opp: str = "opp_team") -> DataFrame:
    keyed = rows.withColumn("match_key", S.pair_key(F.col(ts), F.col(team), F.col(opp)))
    return keyed.join(match_ids(rows, ts, team, opp), "match_key", "left")


def completed_rounds(rows: DataFrame, as_of: Column, round_column: str = "round", ts: str = "datetime") -> DataFrame:
    """Rounds whose last kickoff is not after `as_of`."""
    return (
        rows.groupBy(round_column)
        .agg(F.max(ts).alias("last_kickoff"))
        .where(F.col("last_kickoff") <= as_of)
    )


def next_round(rows: DataFrame, as_of: Column, round_column: str = "round", ts: str = "datetime") -> DataFrame:
    """Round to predict next: the latest started one while it still has future matches, else the one after.

    One row; `next_round` is NULL when nothing lies in the future. Rounds are reduced first.
    """
    by_round = rows.groupBy(round_column).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    current = F.max(F.when(F.col("_first") <= as_of, F.col(round_column)))
    open_rounds = F.collect_set(F.when(F.col("_last") > as_of, F.col(round_column)))
    state = by_round.agg(current.alias("current_round"), open_rounds.alias("_open"))
    still_open = F.array_contains("_open", F.col("current_round"))
    return state.select(
        "current_round",
        F.when(F.size("_open") == 0, F.lit(None).cast("int"))
        .when(F.col("current_round").isNull(), F.array_min("_open"))
        .when(still_open, F.col("current_round"))
        .otherwise(F.col("current_round") + 1)
        .alias("next_round"),
    )


def require_next_round(rows: DataFrame, as_of: Column) -> int:
    """The round as a number; an error when no match lies ahead."""
    value = next_round(rows, as_of).first()["next_round"]
    if value is None:
        raise ValueError("no upcoming matches to predict")
    return value


def round_actuals(rows: DataFrame, round_column: str = "round") -> DataFrame:
    """Result of every match, once, from the host's row."""
    return rows.where(F.col("is_home") == 1).select(
        round_column,
        F.col("team").alias("home_team"),
        F.col("opp_team").alias("away_team"),
        F.col("goals").alias("goals_home"),
        F.col("goals_against").alias("goals_away"),
    )


def model_shape(rows: DataFrame, max_round: int | None = None) -> DataFrame:
    """Team count over all rows; match, observation and time-step counts over the training rows."""
    train = F.lit(True) if max_round is None else F.col("round") <= max_round
    teams = rows.select(F.explode(F.array("team", "opp_team")).alias("team")).distinct()
    shape = rows.where(train).agg(
        F.count_distinct("match_id").alias("n_matches"),
        F.count(F.lit(1)).alias("n_obs"),
        (F.max("cum_round") + 1).cast("long").alias("n_time"),
    )
    return shape.crossJoin(teams.agg(F.count(F.lit(1)).alias("n_teams")))
