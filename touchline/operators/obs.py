"""Leakage-free expanding averages and model observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.reshape import add_team_ids
from touchline.session import small_side

DEFAULT_XG = 1.5


def expanding_means(
    rows: DataFrame, *, team: str = "team", t: str = "cum_round", value: str = "xG", against: str = "xGA",
    default: float = DEFAULT_XG,
) -> DataFrame:
    """Per (team, t): mean scored and conceded value over all rows strictly before t.

    Rows are first summed to one per (team, t); the running sum then scans at most one row per round.
    """
    sums = rows.groupBy(F.col(team).alias("team"), F.col(t).alias("t")).agg(
        F.sum(value).alias("_own"), F.sum(against).alias("_other"), F.count(value).alias("_n_own"), F.count(against).alias("_n_other")
    )
    return _means(sums, default)


def _means(sums: DataFrame, default: float) -> DataFrame:
    before = Window.partitionBy("team").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)

    def mean(c: str):
        return F.coalesce(F.try_divide(F.sum(c).over(before), F.sum(f"_n{c}").over(before)), F.lit(float(default)))

    return sums.select("team", "t", mean("_own").alias("xg_avg"), mean("_other").alias("xga_avg"))


def expanding_grid(
    rows: DataFrame, *, team: str = "team", t: str = "cum_round", value: str = "xG", against: str = "xGA",
    default: float = DEFAULT_XG,
) -> DataFrame:
    """Dense (t, team) version of `expanding_means`: every team at every t from 0, default where no past.

    The grid is teams x rounds, both reduced from the rows first.
    """
    sums = rows.groupBy(F.col(team).alias("team"), F.col(t).alias("t")).agg(
        F.sum(value).alias("_own"), F.sum(against).alias("_other"), F.count(value).alias("_n_own"), F.count(against).alias("_n_other")
    )
    last = sums.agg(F.max("t").alias("_last"))
    grid = (
        sums.select("team").distinct()
        .crossJoin(F.broadcast(last))  # one row
        .select("team", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("t"))
    )
    return _means(grid.join(sums, ["team", "t"], "left"), default)


def xg_baseline(rows: DataFrame, means: DataFrame, *, t: str = "cum_round") -> DataFrame:
    """Pre-match expected goals of host and visitor on both kinds of row.

    `means` has one row per (team, t); it is computed once for both lookups.
    """
    means = small_side(means)
    host = F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opp_team"))
    guest = F.when(F.col("is_home") == 1, F.col("opp_team")).otherwise(F.col("team"))
    h = means.select(F.col("team").alias("_host"), F.col("t").alias("_ht"), F.col("xg_avg").alias("_hx"), F.col("xga_avg").alias("_ha"))
    g = means.select(F.col("team").alias("_guest"), F.col("t").alias("_gt"), F.col("xg_avg").alias("_gx"), F.col("xga_avg").alias("_ga"))
    return (
        rows.withColumns({"_h": host, "_g": guest})
        .join(h, (F.col("_h") == F.col("_host")) & (F.col(t) == F.col("_ht")), "left")
        .join(g, (F.col("_g") == F.col("_guest")) & (F.col(t) == F.col("_gt")), "left")
        .withColumns(
            {"xg_home_baseline": (F.col("_hx") + F.col("_ga")) / 2, "xg_away_baseline": (F.col("_gx") + F.col("_ha")) / 2}
        )
        .drop("_h", "_g", "_host", "_ht", "_hx", "_ha", "_guest", "_gt", "_gx", "_ga")
    )


def observations(rows: DataFrame, teams: DataFrame, max_round: int | None = None) -> DataFrame:
    """Model observations: ids, home flag, own and opponent goals, pre-match baselines."""
    train = rows if max_round is None else rows.where(F.col("round") <= max_round)
    means = expanding_means(train)
    with_base = xg_baseline(train, means)
    return add_team_ids(with_base, teams).select(
        F.col("cum_round").alias("t"), "team_id", "opp_id", "match_id",
        F.col("is_home").cast("double").alias("home"),
        F.col("goals").alias("goals_home"), F.col("goals_against").alias("goals_away"),
        F.col("xg_home_baseline").alias("xG_home"), F.col("xg_away_baseline").alias("xG_away"),
    )
