"""Queries: sources, reshape, rounds, calendar state and the table store."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import reshape, rounds
from touchline.plans import fixtures as fx
from touchline.plans.registry import query, sql
from touchline.sources import store

AS_OF = "2000-03-15"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("matches_by_season", sql("""SELECT season, CAST(count(*) AS BIGINT) AS n_matches,
  CAST(sum(goals_home) AS BIGINT) AS goals_home, CAST(sum(goals_away) AS BIGINT) AS goals_away,
  CAST(sum(xg_home_c) AS BIGINT) AS xg_home_c FROM m WHERE season IN ('1996','1997','1998','1999') GROUP BY season""", "m"))
def matches_by_season(spark, sf):
    m = fx.matches(spark, sf).where(F.col("season").isin("1996", "1997", "1998", "1999"))
    return m.groupBy("season").agg(
        F.count(F.lit(1)).alias("n_matches"),
        *[F.sum(c).cast("long").alias(c) for c in ("goals_home", "goals_away", "xg_home_c")],
    )


@query("missing_partitions", sql("""SELECT r_name AS league, CAST(y AS VARCHAR) AS season, CAST(count(match_no) AS BIGINT) AS n_rows,
  CASE WHEN count(match_no) = 0 THEN 'missing' ELSE 'ok' END AS status
FROM region CROSS JOIN (SELECT unnest(range(1993, 2003)) AS y) ys
LEFT JOIN (SELECT m.season, n_regionkey, match_no FROM m JOIN nation ON home = n_nationkey) x
  ON x.n_regionkey = r_regionkey AND x.season = CAST(y AS VARCHAR) GROUP BY 1, 2""", "m"))
def missing_partitions(spark, sf):
    nation, region = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    dims = F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))
    rows = fx.matches(spark, sf).join(dims, F.col("home") == F.col("n_nationkey")).select(F.col("r_name").alias("league"), "season")
    years = F.explode(F.transform(F.sequence(F.lit(1993), F.lit(2002)), lambda y: y.cast("string")))
    wanted = region.select(F.col("r_name").alias("league"), years.alias("season"))
    return store.partition_report(rows, wanted, ["league", "season"])


@query("flatten_match", sql("""SELECT match_no % 1000 AS bucket, season, 'N' || home AS h_short_title, 'NATION ' || away AS a_title,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN match_no % 50 = 0 THEN 0 ELSE goals_home END) AS BIGINT) AS h_g,
  CAST(sum(CASE WHEN match_no % 50 = 0 THEN 0 ELSE goals_away END) AS BIGINT) AS a_g,
  CAST(sum(CASE WHEN match_no % 50 = 0 THEN 0 ELSE xg_home_c END) AS BIGINT) AS h_xg,
  CAST(sum(CASE WHEN match_no % 50 = 0 THEN 0 ELSE xg_away_c END) AS BIGINT) AS a_xg,
  CAST(sum(CASE WHEN match_no % 50 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS played,
  min(strftime(datetime, '%Y-%m-%d')) AS first_day
FROM m GROUP BY 1, 2, 3, 4""", "m"))
def flatten_match(spark, sf):
    flat = reshape.flatten_matches(fx.raw_matches(spark, sf), keep=["id", "season"])
    return flat.groupBy((F.col("id").cast("long") % 1000).alias("bucket"), "season", "h_short_title", "a_title").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h_g").alias("h_g"), F.sum("a_g").alias("a_g"),
        F.sum("h_xG").cast("long").alias("h_xg"), F.sum("a_xG").cast("long").alias("a_xg"),
        F.sum("is_played").alias("played"), F.date_format(F.min("datetime"), "yyyy-MM-dd").alias("first_day"),
    )


@query("team_matches", sql("SELECT match_no, season, team, opp_team, is_home, goals, goals_against, xg_c, xga_c, win, loss, draw, gd FROM l",
                           "m", "l0", "l"))
def team_matches(spark, sf):
    return fx.team_rows(spark, sf).drop("datetime")


@query("perspective_columns", sql("""SELECT match_no, is_home, goals AS goals_home, goals_against AS goals_away, xg_c AS xg_c_home, xga_c AS xg_c_away,
  CASE WHEN is_home = 1 THEN goals ELSE goals_against END AS home_goals, CASE WHEN is_home = 1 THEN goals_against ELSE goals END AS away_goals
FROM l""", "m", "l0", "l"))
def perspective_columns(spark, sf):
    out = reshape.perspective_columns(fx.team_rows(spark, sf), {"goals": "goals_against", "xg_c": "xga_c"}, true_sides=True)
    return out.select("match_no", "is_home", "goals_home", "goals_away", "xg_c_home", "xg_c_away", "home_goals", "away_goals")


@query("season_rounds", sql("SELECT match_no, season, round_in_season FROM mr", "m", "wk", "rnd", "off", "cal", "mr"))
def season_rounds(spark, sf):
    return fx.rounded_matches(spark, sf).select("match_no", "season", "round_in_season")


@query("season_rounds_iso", sql("""CTE w AS (SELECT *, week(datetime - INTERVAL 1 DAY) AS wn FROM m),
f AS (SELECT season, arg_min(wn, (datetime, wn)) AS first_wn FROM w GROUP BY season),
a AS (SELECT match_no, w.season, CASE WHEN wn < first_wn THEN wn + 52 ELSE wn END - first_wn + 1 AS r FROM w JOIN f ON w.season = f.season)
SELECT match_no, season, CAST(dense_rank() OVER (PARTITION BY season ORDER BY r) AS INT) AS round_in_season FROM a""", "m"))
def season_rounds_iso(spark, sf):
    return rounds.add_rounds(fx.matches(spark, sf), mode="iso_week").select("match_no", "season", "round_in_season")


@query("cum_round", sql("""SELECT cal.season, CAST(cal.round_in_season AS INT) AS round_in_season, cal.cum_round,
  CAST(rounds AS BIGINT) AS rounds, CAST(round_offset AS BIGINT) AS round_offset, CAST(count(*) AS BIGINT) AS n_matches
FROM mr JOIN cal ON mr.season = cal.season AND mr.round_in_season = cal.round_in_season JOIN off ON off.season = cal.season
GROUP BY 1, 2, 3, 4, 5""", "m", "wk", "rnd", "off", "cal", "mr"))
def cum_round(spark, sf):
    m = fx.rounded_matches(spark, sf)
    by_round = m.groupBy("season", "round_in_season", "cum_round").agg(F.count(F.lit(1)).alias("n_matches"))
    # One row per season.
    return by_round.join(F.broadcast(rounds.season_offsets(by_round)), "season")


@query("match_ids", sql("""CTE k AS (SELECT match_no, is_home, strftime(datetime, '%Y-%m-%d %H:%M:%S') || '_' ||
  least(CAST(team AS VARCHAR), CAST(opp_team AS VARCHAR)) || '_' || greatest(CAST(team AS VARCHAR), CAST(opp_team AS VARCHAR)) AS match_key FROM l)
SELECT match_no, is_home, match_key, CAST(dense_rank() OVER (ORDER BY match_key) - 1 AS BIGINT) AS match_id FROM k""", "m", "l0", "l"))
def match_ids(spark, sf):
    return rounds.add_match_ids(fx.team_rows(spark, sf)).select("match_no", "is_home", "match_key", "match_id")


@query("team_index", sql("""CTE f AS (SELECT team, min(datetime) AS d FROM (SELECT team, datetime FROM l UNION ALL SELECT opp_team, datetime FROM l) GROUP BY team),
i AS (SELECT team, CAST(row_number() OVER (ORDER BY d, team) - 1 AS INT) AS team_id FROM f)
SELECT match_no, is_home, a.team_id, b.team_id AS opp_id FROM l JOIN i a ON l.team = a.team JOIN i b ON l.opp_team = b.team""",
                         "m", "l0", "l"))
def team_index(spark, sf):
    rows = fx.team_rows(spark, sf)
    return reshape.add_team_ids(rows, reshape.team_index(rows)).select("match_no", "is_home", "team_id", "opp_id")


@query("normalise_names", sql("""SELECT n, CASE n WHEN 'MIDDLE EAST' THEN 'MidEast' ELSE replace(n, ' ', '') END AS club, CAST(count(*) AS BIGINT) AS n_rows
FROM (SELECT r_name AS n FROM region UNION ALL SELECT p_name FROM part) GROUP BY 1, 2"""))
def normalise_names(spark, sf):
    names = fx.table(spark, sf, "region").select(F.col("r_name").alias("n")).union(fx.table(spark, sf, "part").select("p_name"))
    out = reshape.normalise_names(names.withColumn("club", F.col("n")), "club", {"MIDDLE EAST": "MidEast"})
    return out.groupBy("n", "club").agg(F.count(F.lit(1)).alias("n_rows"))


@query("completed_rounds", sql(f"""SELECT cum_round AS round, strftime(max(datetime), '%Y-%m-%d') AS last_day FROM mr GROUP BY 1
HAVING max(datetime) <= TIMESTAMP '{AS_OF}'""", "m", "wk", "rnd", "off", "cal", "mr"))
def completed_rounds(spark, sf):
    done = rounds.completed_rounds(fx.rounded_matches(spark, sf), as_of())
    return done.select("round", F.date_format("last_kickoff", "yyyy-MM-dd").alias("last_day"))


@query("next_round", sql(f"""CTE c AS (SELECT max(cum_round) AS cur FROM mr WHERE datetime <= TIMESTAMP '{AS_OF}'),
f AS (SELECT DISTINCT cum_round FROM mr WHERE datetime > TIMESTAMP '{AS_OF}')
SELECT cur AS current_round, CAST(CASE WHEN (SELECT count(*) FROM f) = 0 THEN NULL WHEN cur IN (SELECT cum_round FROM f) THEN cur ELSE cur + 1 END AS INT) AS next_round FROM c""",
                         "m", "wk", "rnd", "off", "cal", "mr"))
def next_round(spark, sf):
    return rounds.next_round(fx.rounded_matches(spark, sf), as_of())


@query("round_actuals", sql("SELECT cum_round AS round, home AS home_team, away AS away_team, goals_home, goals_away FROM mr",
                            "m", "wk", "rnd", "off", "cal", "mr"))
def round_actuals(spark, sf):
    return rounds.round_actuals(fx.rounded_rows(spark, sf))


@query("model_shape", sql(f"""CTE k AS (SELECT *, strftime(datetime, '%Y-%m-%d %H:%M:%S') || '_' || least(CAST(team AS VARCHAR), CAST(opp_team AS VARCHAR)) || '_' ||
  greatest(CAST(team AS VARCHAR), CAST(opp_team AS VARCHAR)) AS match_key FROM lr)
SELECT CAST(count(DISTINCT match_key) AS BIGINT) AS n_matches, CAST(count(*) AS BIGINT) AS n_obs, CAST(max(cum_round) + 1 AS BIGINT) AS n_time,
  (SELECT CAST(count(DISTINCT team) AS BIGINT) FROM l) AS n_teams FROM k WHERE cum_round <= 200""", "m", "l0", "l", "wk", "rnd", "off", "cal", "lr"))
def model_shape(spark, sf):
    rows = fx.rounded_rows(spark, sf)
    keyed = rows.withColumn("match_id", S.pair_key(F.col("datetime"), F.col("team"), F.col("opp_team")))
    return rounds.model_shape(keyed, max_round=200)


def stored_rounds(spark, sf):
    """Stand-in for the three stored tables, each filled up to a different day."""
    m = fx.rounded_matches(spark, sf)
    until = {"predictions": "2000-06-30", "actuals": AS_OF, "team_strengths": "1999-12-31"}
    return {name: m.where(F.col("datetime") <= F.lit(day).cast("timestamp")) for name, day in until.items()}


STORED = f"""bool_or(datetime <= TIMESTAMP '2000-06-30') AS has_predictions, bool_or(datetime <= TIMESTAMP '{AS_OF}') AS has_actuals,
  bool_or(datetime <= TIMESTAMP '1999-12-31') AS has_team_strengths"""


@query("round_inventory", sql(f"SELECT cum_round AS round, {STORED} FROM mr GROUP BY 1 HAVING bool_or(datetime <= TIMESTAMP '2000-06-30')",
                              "m", "wk", "rnd", "off", "cal", "mr"))
def round_inventory(spark, sf):
    return store.round_inventory(stored_rounds(spark, sf))


@query("rounds_to_process", sql(f"""CTE inv AS (SELECT cum_round AS round, {STORED} FROM mr GROUP BY 1),
c AS (SELECT cum_round AS round, row_number() OVER (ORDER BY cum_round) AS rn FROM mr WHERE cum_round BETWEEN 5 AND 300 AND cum_round NOT IN (10, 20)
  GROUP BY 1 HAVING max(datetime) <= TIMESTAMP '{AS_OF}')
SELECT round FROM c WHERE (rn - 1) % 2 = 0 AND round NOT IN (SELECT round FROM inv WHERE has_predictions AND has_actuals AND has_team_strengths)""",
                                "m", "wk", "rnd", "off", "cal", "mr"))
def rounds_to_process(spark, sf):
    finished = store.finished_rounds(store.round_inventory(stored_rounds(spark, sf)))
    completed = rounds.completed_rounds(fx.rounded_matches(spark, sf), as_of())
    return store.rounds_to_process(completed, start_round=5, end_round=300, skip_rounds=[10, 20], step=2, finished=finished)


@query("run_registry", sql("""CTE t AS (SELECT home AS team, cum_round FROM mr UNION ALL SELECT away, cum_round FROM mr), c AS (SELECT DISTINCT cum_round AS r FROM mr)
SELECT r AS trained_to_round, 'run-' || lpad(CAST(r AS VARCHAR), 4, '0') AS run_id, CAST((SELECT count(*) FROM t WHERE cum_round <= r) AS BIGINT) AS n_obs,
  CAST((SELECT count(DISTINCT team) FROM t WHERE cum_round <= r) AS BIGINT) AS n_teams, (SELECT strftime(max(datetime), '%Y-%m-%d') FROM mr WHERE cum_round <= r) AS created_at
FROM c""", "m", "wk", "rnd", "off", "cal", "mr"))
def run_registry(spark, sf):
    rows = fx.rounded_rows(spark, sf)
    return store.run_registry(rows, F.concat(F.lit("run-"), F.lpad(F.col("round").cast("string"), 4, "0")))


@query("form_table", sql("""SELECT match_no, team, is_home, cum_round, goals, win, draw,
  lag(goals, 1) OVER w AS goals_lag_1, lag(goals, 3) OVER w AS goals_lag_3, lag(goals, 5) OVER w AS goals_lag_5,
  CAST(sum(3 * win + draw) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS BIGINT) AS recent_form
FROM lr WINDOW w AS (PARTITION BY team ORDER BY datetime, match_no)""", "m", "l0", "l", "wk", "rnd", "off", "cal", "lr"))
def form_table(spark, sf):
    """Flagship: matches to team rows, rounds, lags and recent form."""
    from touchline.operators import features
    from touchline.operators.cells import Track

    track = Track(["team"], "datetime", ("match_no",))
    rows = features.positioned(fx.rounded_rows(spark, sf), track)
    rows = features.lag_features(rows, track, ["goals"], (1, 3, 5))
    rows = features.recent_form(rows, track, 5)
    return rows.select("match_no", "team", "is_home", "cum_round", "goals", "win", "draw",
                       "goals_lag_1", "goals_lag_3", "goals_lag_5", "recent_form")
