"""Reshape, rounds, ids, calendar state, as-of ratings, expanding averages."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import asof, obs, reshape, rounds

RAW = (
    "id string, datetime string, h struct<title string, short_title string>, a struct<title string, short_title string>,"
    " goals struct<h string, a string>, xG struct<h string, a string>, season string"
)


def raw(spark, rows):
    return spark.createDataFrame(
        [(str(i), when, (h + " City", h), (a + " Town", a), g, x, s) for i, (when, h, a, g, x, s) in enumerate(rows)], RAW
    )


def test_unplayed_and_malformed_scores_are_zero_filled_and_marked(spark):
    df = raw(spark, [("2024-08-16 19:00:00", "A", "B", ("2", "1"), ("1.5", "0.25"), "2024"),
                     ("2024-08-17 19:00:00", "C", "D", (None, None), (None, None), "2024"),
                     ("2024-08-18 19:00:00", "E", "F", ("x", "1"), ("y", "1"), "2024")])
    rows = {(r["team"], r["is_home"]): r for r in reshape.team_matches(df).collect()}
    assert len(rows) == 6
    a, b = rows[("A", 1)], rows[("B", 0)]
    assert (a["goals"], a["goals_against"], a["xG"], a["xGA"], a["win"], a["gd"]) == (2, 1, 1.5, 0.25, 1, 1)
    assert (b["goals"], b["xG"], b["loss"], b["team_long"], b["opp_team_long"]) == (1, 0.25, 1, "B Town", "A City")
    assert rows[("C", 1)]["draw"] == 1 and rows[("C", 1)]["is_played"] == 0
    assert rows[("E", 1)]["goals"] == 0 and rows[("E", 1)]["is_played"] == 1


def test_reshape_scans_once(spark):
    plan = reshape.team_matches(raw(spark, [("2024-08-16 19:00:00", "A", "B", ("2", "1"), ("1", "0"), "2024")]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text and text.count("LogicalRDD") + text.count("LocalRelation") == 1


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="goals"):
        reshape.flatten_matches(spark.createDataFrame([("x",)], "datetime string"))


def days(spark, items):
    rows = [(dt.datetime.fromisoformat(d), s, h, a) for d, s, h, a in items]
    return spark.createDataFrame(rows, "datetime timestamp, season string, team string, opp_team string")


def test_monday_counts_for_the_week_before_and_rounds_run_on(spark):
    df = days(spark, [("2024-08-17", "2024", "A", "B"), ("2024-08-19", "2024", "C", "D"), ("2024-08-20", "2024", "A", "C"),
                      ("2024-12-29", "2024", "B", "D"), ("2025-08-16", "2025", "A", "B")])
    out = rounds.add_rounds(df).orderBy("datetime").collect()
    assert [r["round_in_season"] for r in out] == [1, 1, 2, 3, 1]
    assert [r["cum_round"] for r in out] == [1, 1, 2, 3, 4]
    assert all(r["round"] == r["cum_round"] for r in out)


def test_53_week_year_in_both_modes(spark):
    # 2020 has ISO week 53; wrapping by 52 puts it with the week after it.
    df = days(spark, [("2020-09-12", "2020", "A", "B"), ("2020-12-30", "2020", "A", "B"), ("2021-01-06", "2020", "A", "B"), ("2021-01-13", "2020", "A", "B")])
    week = [r["round_in_season"] for r in rounds.add_rounds(df).orderBy("datetime").collect()]
    iso = [r["round_in_season"] for r in rounds.add_rounds(df, mode="iso_week").orderBy("datetime").collect()]
    assert week == [1, 2, 3, 4]
    assert iso == [1, 2, 2, 3]
    with pytest.raises(ValueError):
        rounds.round_calendar(df, mode="none")


def test_leagues_have_their_own_rounds(spark):
    df = days(spark, [("2024-08-17", "2024", "A", "B"), ("2024-08-24", "2024", "A", "B")]).withColumn("league", F.lit("X"))
    other = days(spark, [("2024-08-24", "2024", "P", "Q")]).withColumn("league", F.lit("Y"))
    out = rounds.add_rounds(df.union(other), group=["league"]).orderBy("league", "datetime").collect()
    assert [r["cum_round"] for r in out] == [1, 2, 1]


def test_match_ids_are_shared_by_both_sides_and_dense(spark):
    df = days(spark, [("2024-08-18", "2024", "B", "A"), ("2024-08-18", "2024", "A", "B"), ("2024-08-17", "2024", "C", "D"), ("2024-08-17", "2024", "D", "C")])
    out = rounds.add_match_ids(df).collect()
    ids = {(r["team"], r["match_id"]) for r in out}
    assert ids == {("A", 1), ("B", 1), ("C", 0), ("D", 0)}
    assert {r["match_key"] for r in out} == {"2024-08-18 00:00:00_A_B", "2024-08-17 00:00:00_C_D"}


def calendar(spark, items):
    rows = [(dt.datetime.fromisoformat(d), r) for d, r in items]
    return spark.createDataFrame(rows, "datetime timestamp, round int")


def at(text):
    return F.lit(text).cast("timestamp")


def test_next_round_during_between_before_and_after_rounds(spark):
    df = calendar(spark, [("2024-01-01", 1), ("2024-01-03", 1), ("2024-01-10", 2)])
    value = lambda when: rounds.next_round(df, at(when)).first()["next_round"]
    assert value("2024-01-02") == 1
    assert value("2024-01-05") == 2
    assert value("2023-12-01") == 1
    assert value("2024-02-01") is None
    with pytest.raises(ValueError, match="no upcoming"):
        rounds.require_next_round(df, at("2024-02-01"))
    assert [r["round"] for r in rounds.completed_rounds(df, at("2024-01-05")).collect()] == [1]


def test_team_index_orders_by_first_appearance_then_name(spark):
    df = days(spark, [("2024-08-18", "2024", "Z", "Y"), ("2024-08-17", "2024", "B", "C"), ("2024-08-19", "2024", "A", "B")])
    index = {r["team"]: r["team_id"] for r in reshape.team_index(df).collect()}
    assert index == {"B": 0, "C": 1, "Y": 2, "Z": 3, "A": 4}


def test_club_names(spark):
    df = spark.createDataFrame([("Manchester City",), ("Aston Villa",), ("Arsenal",)], "n string")
    assert [r[0] for r in df.select(S.club_key(F.col("n"))).collect()] == ["ManCity", "AstonVilla", "Arsenal"]


def test_asof_matches_pandas_merge_asof(spark):
    left = pd.DataFrame({"team": list("AABBC"), "datetime": pd.to_datetime(["2024-01-05", "2024-03-01", "2024-01-01", "2024-06-01", "2024-01-01"])})
    right = pd.DataFrame({"team": list("AAB"), "valid_from": pd.to_datetime(["2024-01-05", "2024-02-01", "2024-02-01"]), "rating": [1.0, 2.0, 3.0]})
    got = asof.asof_join(spark.createDataFrame(left), spark.createDataFrame(right)).toPandas().sort_values(["team", "datetime"])
    want = pd.merge_asof(left.sort_values("datetime"), right.sort_values("valid_from"), left_on="datetime", right_on="valid_from", by="team")
    want = want.sort_values(["team", "datetime"])
    assert got.rating.astype(float).fillna(-1).tolist() == want.rating.fillna(-1).tolist()


def test_ratings_name_prefix_end_check_and_day(spark):
    rows = spark.createDataFrame([("Manchester City", dt.datetime(2024, 1, 5, 20)), ("Nobody FC", dt.datetime(2024, 1, 5))], "team string, datetime timestamp")
    history = spark.createDataFrame(
        [("Man City", 1900.0, dt.date(2024, 1, 5), dt.date(2024, 1, 5)), ("Man City", None, dt.date(2024, 1, 5), dt.date(2024, 1, 9)),
         ("Man City", 1850.0, dt.date(2023, 1, 5), dt.date(2024, 1, 4))], "Club string, Elo double, `From` date, `To` date")
    out = {r["team"]: r for r in asof.asof_ratings(rows, history, prefix="home").collect()}
    assert out["ManCity"]["home_Elo"] == 1900.0 and out["NobodyFC"]["home_Elo"] is None
    assert set(out["ManCity"].asDict()) == {"team", "datetime", "home_Elo", "home_To", "home_From"}
    late = rows.withColumn("datetime", F.lit("2024-02-01").cast("timestamp"))
    assert asof.asof_ratings(late, history, check_end=True).where("Elo is not null").count() == 0
    assert [r["team"] for r in asof.teams_without_ratings(rows, history.withColumnRenamed("Club", "team")).orderBy("team").collect()] == ["Manchester City", "Nobody FC"]


def test_two_ratings_on_one_day_take_the_larger(spark):
    left = spark.createDataFrame([("A", dt.datetime(2024, 1, 5))], "team string, datetime timestamp")
    right = spark.createDataFrame([("A", dt.datetime(2024, 1, 5), 1.0), ("A", dt.datetime(2024, 1, 5), 7.0)], "team string, valid_from timestamp, rating double")
    assert asof.asof_join(left, right).first()["rating"] == 7.0


def test_expanding_means_use_only_the_past(spark):
    rows = spark.createDataFrame([("A", "B", 1, 1.0, 2.0, 1), ("B", "A", 1, 2.0, 1.0, 0), ("A", "B", 3, 5.0, 0.0, 0), ("B", "A", 3, 0.0, 5.0, 1)],
                                 "team string, opp_team string, cum_round int, xG double, xGA double, is_home int")
    m = {(r["team"], r["t"]): (r["xg_avg"], r["xga_avg"]) for r in obs.expanding_means(rows).collect()}
    assert m[("A", 1)] == (1.5, 1.5) and m[("A", 3)] == (1.0, 2.0) and m[("B", 3)] == (2.0, 1.0)
    grid = {(r["team"], r["t"]): r["xg_avg"] for r in obs.expanding_grid(rows).collect()}
    assert len(grid) == 8 and grid[("A", 0)] == 1.5 and grid[("A", 2)] == 1.0
    base = {(r["team"], r["cum_round"]): (r["xg_home_baseline"], r["xg_away_baseline"]) for r in obs.xg_baseline(rows, obs.expanding_means(rows)).collect()}
    # Round 3: B hosts A on both perspectives.
    assert base[("A", 3)] == base[("B", 3)] == ((2.0 + 2.0) / 2, (1.0 + 1.0) / 2)


def test_observations(spark):
    df = raw(spark, [("2024-08-16 19:00:00", "A", "B", ("2", "1"), ("1.5", "0.25"), "2024"), ("2024-08-24 19:00:00", "B", "A", ("0", "0"), ("1", "1"), "2024")])
    rows = rounds.add_match_ids(rounds.add_rounds(reshape.team_matches(df)))
    out = obs.observations(rows, reshape.team_index(rows), max_round=2)
    assert out.columns == ["t", "team_id", "opp_id", "match_id", "home", "goals_home", "goals_away", "xG_home", "xG_away"]
    assert out.count() == 4 and out.where("home = 1").count() == 2
    assert obs.observations(rows, reshape.team_index(rows), max_round=1).count() == 2
    assert rounds.model_shape(rows, 1).first().asDict() == {"n_matches": 1, "n_obs": 2, "n_time": 2, "n_teams": 2}


def test_log_factorial_beyond_twenty_and_rate_limits(spark):
    import math

    df = spark.createDataFrame([(0, 0.0), (3, 0.0), (25, 3.5), (20, 1.0), (21, 1.0)], "k int, r double")
    got = [r[0] for r in df.select(S.poisson_logpmf(F.col("k"), F.col("r"))).collect()]
    assert got[0] == 0.0 and got[1] == float("-inf")
    assert all(math.isclose(g, k * math.log(r) - r - math.lgamma(k + 1), rel_tol=1e-12) for g, (k, r) in list(zip(got, [(0, 0), (3, 0), (25, 3.5), (20, 1.0), (21, 1.0)]))[2:])
    x = spark.createDataFrame([(0.001,), (50.0,), (None,), (3.0,)], "x double")
    assert [r[0] for r in x.select(S.hard_clip(F.col("x"), 0.01, 10)).collect()] == [0.01, 10.0, None, 3.0]


def test_expanding_means_count_each_value(spark):
    from touchline.operators import obs

    rows = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, None, 4.0), ("a", 2, 1.0, 1.0), ("a", 3, 9.0, 9.0)], "team string, cum_round int, xG double, xGA double")
    last = {r["t"]: r for r in obs.expanding_means(rows).collect()}[3]
    assert last["xg_avg"] == 1.0 and last["xga_avg"] == 7 / 3


def test_registry_counts_all_rounds_up_to_the_run(spark):
    from datetime import datetime

    from touchline.sources import store

    rows = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (1, "b", datetime(2024, 1, 1)), (3, "a", datetime(2024, 1, 9)), (3, "c", datetime(2024, 1, 8))], "round int, team string, datetime timestamp")
    got = {r["trained_to_round"]: (r["n_obs"], r["n_teams"], r["created_at"]) for r in store.run_registry(rows, F.lit("x")).collect()}
    assert got == {1: (2, 2, "2024-01-01"), 3: (4, 3, "2024-01-09")}
