"""Queries: past-only features, fills, as-of ratings and expanding averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import asof, features, obs
from touchline.operators.cells import Track
from touchline.plans import fixtures as fx
from touchline.plans.registry import query, sql, view

TEAM = Track(["team"], "datetime", ("match_no",))
USER = Track(["user_id"], "ts", ("event_id",))
LR = ("m", "l0", "l", "wk", "rnd", "off", "cal", "lr")
LP = (*LR, "lp")


def decay_sql(span: int) -> str:
    """The per-row decay as a double literal, same value as in Spark."""
    return f"{1.0 - 2.0 / (span + 1.0)!r}::DOUBLE"


@query("lag_features", sql("SELECT match_no, team, is_home, " + ", ".join(
    f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for k in (1, 3, 5) for c in ("goals", "xg_c", "goals_against", "xga_c", "win", "loss", "draw", "is_home")
) + " FROM lr WINDOW w AS (PARTITION BY team ORDER BY datetime, match_no)", *LR))
def lag_features(spark, sf):
    columns = ("goals", "xg_c", "goals_against", "xga_c", "win", "loss", "draw", "is_home")
    out = features.lag_features(fx.team_rows(spark, sf), TEAM, columns)
    return out.select("match_no", "team", "is_home", *[f"{c}_lag_{k}" for k in (1, 3, 5) for c in columns])


@query("ewm_features", sql(f"""SELECT a.event_id, round(sum(b.value * pow({decay_sql(5)}, a.pos - 1 - b.pos)) /
  sum(CASE WHEN b.value IS NOT NULL THEN pow({decay_sql(5)}, a.pos - 1 - b.pos) END), 6) AS value_ewm
FROM evp a LEFT JOIN evp b ON a.user_id = b.user_id AND b.pos < a.pos GROUP BY a.event_id""", "ev", "evp"))
def ewm_features(spark, sf):
    out = features.ewm_features(fx.events(spark, sf), USER, {"value_ewm": "value"}, 5)
    return out.select("event_id", F.round("value_ewm", 6).alias("value_ewm"))


@query("cumsum_features", sql("""SELECT event_id, CAST(CASE WHEN lag(CASE WHEN event_id % 7 <> 0 THEN cents END) OVER w IS NOT NULL THEN
  sum(CASE WHEN event_id % 7 <> 0 THEN cents END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS BIGINT) AS cumsum_cents
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", "ev"))
def cumsum_features(spark, sf):
    e = fx.events(spark, sf).withColumn("x", F.when(F.col("value").isNotNull(), F.col("cents")))
    return features.cumsum_features(e, USER, {"cumsum_cents": "x"}).select("event_id", "cumsum_cents")


EWM_NEAR = 150
view("ewm4", f"""SELECT a.match_no, a.team, a.is_home, """ + ", ".join(
    f"sum(b.{c} * pow({decay_sql(5)}, a.pos - 1 - b.pos)) / sum(pow({decay_sql(5)}, a.pos - 1 - b.pos)) AS {c}_e"
    for c in ("goals", "xg_c", "goals_against", "xga_c")
) + f" FROM lp a LEFT JOIN lp b ON a.team = b.team AND b.pos BETWEEN a.pos - {EWM_NEAR} AND a.pos - 1 GROUP BY 1, 2, 3")


@query("efficiency_ratios", sql("""SELECT match_no, team, is_home, round(goals_e / nullif(xg_c_e / 100.0::DOUBLE, 0), 6) AS goal_efficiency,
  round(1 - goals_against_e / nullif(xga_c_e / 100.0::DOUBLE, 0), 6) AS defensive_efficiency FROM ewm4""", *LP, "ewm4"))
def efficiency_ratios(spark, sf):
    rows = fx.team_rows(spark, sf).withColumns({"xG": F.col("xg_c") / 100, "xGA": F.col("xga_c") / 100})
    names = {f"rolling_{c}_avg": c for c in features.METRICS}
    out = features.efficiency_ratios(features.ewm_features(rows, TEAM, names, 5, long_gaps=False))
    return out.select("match_no", "team", "is_home", F.round("goal_efficiency", 6).alias("goal_efficiency"),
                      F.round("defensive_efficiency", 6).alias("defensive_efficiency"))


@query("venue_win_rates", sql(f"""CTE v AS (SELECT *, row_number() OVER (PARTITION BY team, is_home ORDER BY datetime, match_no) AS vp FROM l),
r AS (SELECT a.match_no, a.team, a.is_home, round(sum(b.win * pow({decay_sql(5)}, a.vp - 1 - b.vp)) / sum(pow({decay_sql(5)}, a.vp - 1 - b.vp)), 6) AS rate
  FROM v a LEFT JOIN v b ON a.team = b.team AND a.is_home = b.is_home AND b.vp BETWEEN a.vp - {EWM_NEAR} AND a.vp - 1 GROUP BY 1, 2, 3)
SELECT match_no, team, is_home, CASE WHEN is_home = 1 THEN rate END AS home_win_rate, CASE WHEN is_home = 0 THEN rate END AS away_win_rate FROM r""",
                              "m", "l0", "l"))
def venue_win_rates(spark, sf):
    out = features.venue_win_rates(fx.team_rows(spark, sf), TEAM, 5)
    return out.select("match_no", "team", "is_home", F.round("home_win_rate", 6).alias("home_win_rate"),
                      F.round("away_win_rate", 6).alias("away_win_rate"))


@query("recent_form", sql("""SELECT match_no, team, is_home, CAST(sum(3 * win + draw) OVER (PARTITION BY team ORDER BY datetime, match_no
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS BIGINT) AS recent_form FROM l""", "m", "l0", "l"))
def recent_form(spark, sf):
    return features.recent_form(fx.team_rows(spark, sf), TEAM, 5).select("match_no", "team", "is_home", "recent_form")


def streak_sql(hit: str, unknown: bool = False) -> str:
    start = -1 if unknown else 0
    return sql(f"""SELECT event_id, CAST(pos - 1 - coalesce(max(CASE WHEN NOT ({hit}) THEN pos END) OVER (PARTITION BY user_id ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {start}) AS BIGINT) AS streak FROM evp""", "ev", "evp")


@query("win_streak", streak_sql("win = 1"))
def win_streak(spark, sf):
    out = features.streaks(fx.events(spark, sf), USER, {"streak": F.col("win") != 0})
    return out.select("event_id", "streak")


@query("loss_streak", streak_sql("win = 0 AND draw = 0", unknown=True))
def loss_streak(spark, sf):
    lost = (F.col("win") == 0) & (F.col("draw") == 0)
    out = features.streaks(fx.events(spark, sf), USER, {"streak": lost}, unknown_counts=True)
    return out.select("event_id", "streak")


@query("unbeaten_streak", sql("""SELECT match_no, team, is_home, CAST(pos - 1 - coalesce(max(CASE WHEN win + draw = 0 THEN pos END) OVER (PARTITION BY team ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS unbeaten_streak FROM lp""", *LP))
def unbeaten_streak(spark, sf):
    out = features.streaks(fx.team_rows(spark, sf), TEAM, {"unbeaten_streak": (F.col("win") + F.col("draw")) > 0})
    return out.select("match_no", "team", "is_home", "unbeaten_streak")


@query("rest_days", sql("""SELECT event_id, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400000000.0) AS INT) AS rest_days FROM ev""", "ev"))
def rest_days(spark, sf):
    return features.rest_days(fx.events(spark, sf), USER, "rest_days").select("event_id", "rest_days")


@query("fill_forward", sql("""SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ev""", "ev"))
def fill_forward(spark, sf):
    return features.fill(fx.events(spark, sf), USER, ["value"], "ffill").select("event_id", "value")


@query("fill_backward", sql("""SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ev""", "ev"))
def fill_backward(spark, sf):
    return features.fill(fx.events(spark, sf), USER, ["value"], "bfill").select("event_id", "value")


@query("fill_mean", sql("""CTE x AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN cents END AS c FROM ev)
SELECT event_id, coalesce(CAST(c AS DOUBLE), (SELECT CAST(sum(c) AS DOUBLE) / count(c) FROM x)) AS cents FROM x""", "ev"))
def fill_mean(spark, sf):
    e = fx.events(spark, sf).select("event_id", "user_id", "ts", F.when(F.col("value").isNotNull(), F.col("cents")).alias("cents"))
    return features.fill(e, USER, ["cents"], "mean").select("event_id", "cents")


@query("fill_median", sql("""CTE x AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN cents END AS c FROM ev)
SELECT event_id, coalesce(CAST(c AS DOUBLE), (SELECT CAST(quantile_cont(c, 0.5) AS DOUBLE) FROM x)) AS cents FROM x""", "ev"))
def fill_median(spark, sf):
    e = fx.events(spark, sf).select("event_id", "user_id", "ts", F.when(F.col("value").isNotNull(), F.col("cents")).alias("cents"))
    return features.fill(e, USER, ["cents"], "median").select("event_id", "cents")


#: Every feature of the table in SQL: name -> (expression over a team's rows in order, type or None to round).
_EARLIER = "(w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SOURCES = {"goals": "goals", "xG": "xg_c", "goals_against": "goals_against", "xGA": "xga_c", "win": "win", "loss": "loss", "draw": "draw", "is_home": "lp.is_home"}


def _in_units(c: str, expression: str) -> tuple[str, str | None]:
    """Hundredths are divided last."""
    return (f"({expression}) / 100.0::DOUBLE", None) if c.startswith("x") else (expression, "INT")


TABLE = {
    **{f"{c}_lag_{k}": _in_units(c, f"lag({x}, {k}) OVER w") for c, x in _SOURCES.items() for k in (1, 3, 5)},
    **{f"cumsum_{c}": (_in_units(c, f"sum({_SOURCES[c]}) OVER {_EARLIER}")[0], None if c.startswith("x") else "BIGINT") for c in features.METRICS},
    **{f"rolling_{c}_avg": (_in_units(c, f"{_SOURCES[c]}_e")[0], None) for c in features.METRICS},
    "goal_efficiency": ("goals_e / nullif(xg_c_e / 100.0::DOUBLE, 0)", None),
    "defensive_efficiency": ("1 - goals_against_e / nullif(xga_c_e / 100.0::DOUBLE, 0)", None),
    "recent_form": ("sum(3 * win + draw) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "BIGINT"),
    **{f"{n}_streak": (f"pos - 1 - coalesce(max(CASE WHEN {of} = 0 THEN pos END) OVER {_EARLIER}, 0)", "BIGINT")
       for n, of in (("win", "win"), ("loss", "loss"), ("unbeaten", "win + draw"))},
    "days_since_last_match": ("date_diff('day', lag(datetime) OVER w, datetime)", "INT"),
    "home_win_rate": ("CASE WHEN lp.is_home = 1 THEN rate END", None),
    "away_win_rate": ("CASE WHEN lp.is_home = 0 THEN rate END", None),
}


def _filled(name: str, kind: str | None) -> str:
    value = f"last_value({name} IGNORE NULLS) OVER w"
    return f"CAST({value} AS {kind}) AS {name}" if kind else f"round({value}, 6) AS {name}"


@query("feature_table", sql(f"""CTE v AS (SELECT *, row_number() OVER (PARTITION BY team, is_home ORDER BY datetime, match_no) AS vp FROM l),
r AS (SELECT a.match_no, a.team, a.is_home, sum(b.win * pow(DECAY, a.vp - 1 - b.vp)) / sum(pow(DECAY, a.vp - 1 - b.vp)) AS rate
  FROM v a LEFT JOIN v b ON a.team = b.team AND a.is_home = b.is_home AND b.vp BETWEEN a.vp - 150 AND a.vp - 1 GROUP BY 1, 2, 3),
f AS (SELECT lp.match_no, lp.team, lp.is_home, pos, {", ".join(f"{x} AS {n}" for n, (x, _) in TABLE.items())}
  FROM lp JOIN ewm4 e ON e.match_no = lp.match_no AND e.team = lp.team JOIN r ON r.match_no = lp.match_no AND r.team = lp.team
  WINDOW w AS (PARTITION BY lp.team ORDER BY pos))
SELECT match_no, team, is_home, {", ".join(_filled(n, kind) for n, (_, kind) in TABLE.items())}
FROM f WINDOW w AS (PARTITION BY team ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("DECAY", decay_sql(5)), *LP, "ewm4"))
def feature_table(spark, sf):
    rows = fx.team_rows(spark, sf).select(
        "match_no", "datetime", "team", "opp_team", "is_home", "goals", "goals_against", "win", "loss", "draw",
        (F.col("xg_c") / 100).alias("xG"), (F.col("xga_c") / 100).alias("xGA"),
    )
    out = features.feature_table(rows, tiebreak=["match_no"])
    return out.select("match_no", "team", "is_home", *[F.col(n) if kind else F.round(n, 6).alias(n) for n, (_, kind) in TABLE.items()])


ASOF = """SELECT {cols} FROM l ASOF LEFT JOIN ratings r ON l.team = r.team AND l.datetime >= r.valid_from"""


@query("asof_rating", sql("""SELECT match_no, l.team, is_home, r.rating, strftime(r.valid_from, '%Y-%m-%d') AS valid_from
FROM l ASOF LEFT JOIN ratings r ON l.team = r.team AND l.datetime >= r.valid_from""", "m", "l0", "l", "ratings"))
def asof_rating(spark, sf):
    out = asof.asof_join(fx.team_rows(spark, sf), fx.ratings(spark, sf))
    return out.select("match_no", "team", "is_home", "rating", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@query("asof_unmatched", sql("""SELECT l.team, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE r.rating IS NULL) AS BIGINT) AS n_unmatched
FROM l ASOF LEFT JOIN ratings r ON l.team = r.team AND l.datetime >= r.valid_from GROUP BY 1 HAVING count(*) FILTER (WHERE r.rating IS NULL) > 0""",
                             "m", "l0", "l", "ratings"))
def asof_unmatched(spark, sf):
    return asof.unmatched(asof.asof_join(fx.team_rows(spark, sf), fx.ratings(spark, sf)))


@query("asof_rating_both_sides", sql("""SELECT match_no, l.team, is_home, a.rating AS team_rating, b.rating AS opp_rating
FROM l ASOF LEFT JOIN ratings a ON l.team = a.team AND l.datetime >= a.valid_from
ASOF LEFT JOIN ratings b ON l.opp_team = b.team AND l.datetime >= b.valid_from""", "m", "l0", "l", "ratings"))
def asof_rating_both_sides(spark, sf):
    out = asof.asof_both_sides(fx.team_rows(spark, sf), fx.ratings(spark, sf), {"team": "team", "opp_team": "opp"})
    return out.select("match_no", "team", "is_home", "team_rating", "opp_rating")


@query("interval_rating", sql("""SELECT match_no, l.team, is_home, CASE WHEN l.datetime <= r.valid_from + INTERVAL 1 DAY THEN r.rating END AS rating
FROM l ASOF LEFT JOIN ratings r ON l.team = r.team AND l.datetime >= r.valid_from""", "m", "l0", "l", "ratings"))
def interval_rating(spark, sf):
    history = fx.ratings(spark, sf).withColumn("valid_to", F.col("valid_from") + F.expr("INTERVAL 1 DAY"))
    out = asof.asof_join(fx.team_rows(spark, sf), history, valid_to="valid_to")
    return out.select("match_no", "team", "is_home", "rating")


view("tt", "SELECT team, cum_round AS t, sum(xg_c) AS own, sum(xga_c) AS other, count(*) AS n FROM lr GROUP BY 1, 2")
view("xm", """SELECT team, t, coalesce(CAST(sum(own) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 150.0::DOUBLE) AS xg_avg,
  coalesce(CAST(sum(other) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 150.0::DOUBLE) AS xga_avg
FROM tt WINDOW w AS (PARTITION BY team ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


def means(spark, sf):
    return obs.expanding_means(fx.rounded_rows(spark, sf), value="xg_c", against="xga_c", default=150.0)


@query("expanding_xg", sql("SELECT team, t, xg_avg FROM xm", *LR, "tt", "xm"))
def expanding_xg(spark, sf):
    return means(spark, sf).select("team", "t", "xg_avg")


@query("expanding_xga", sql("SELECT team, t, xga_avg FROM xm", *LR, "tt", "xm"))
def expanding_xga(spark, sf):
    return means(spark, sf).select("team", "t", "xga_avg")


@query("expanding_xg_grid", sql("""CTE g AS (SELECT team, CAST(unnest(range(0, (SELECT max(t) + 1 FROM tt))) AS INT) AS t FROM (SELECT DISTINCT team FROM tt))
SELECT g.team, g.t, coalesce(CAST(sum(own) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 150.0::DOUBLE) AS xg_avg,
  coalesce(CAST(sum(other) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 150.0::DOUBLE) AS xga_avg
FROM g LEFT JOIN tt ON g.team = tt.team AND g.t = tt.t WINDOW w AS (PARTITION BY g.team ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", *LR, "tt"))
def expanding_xg_grid(spark, sf):
    return obs.expanding_grid(fx.rounded_rows(spark, sf), value="xg_c", against="xga_c", default=150.0)


@query("xg_baseline", sql("""SELECT match_no, is_home, (h.xg_avg + g.xga_avg) / 2 AS xg_home_baseline, (g.xg_avg + h.xga_avg) / 2 AS xg_away_baseline
FROM lr JOIN xm h ON h.team = CASE WHEN is_home = 1 THEN lr.team ELSE opp_team END AND h.t = cum_round
JOIN xm g ON g.team = CASE WHEN is_home = 1 THEN opp_team ELSE lr.team END AND g.t = cum_round""", *LR, "tt", "xm"))
def xg_baseline(spark, sf):
    out = obs.xg_baseline(fx.rounded_rows(spark, sf), means(spark, sf))
    return out.select("match_no", "is_home", "xg_home_baseline", "xg_away_baseline")
