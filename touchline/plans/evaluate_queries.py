"""Queries: baselines, scores, rolling-origin evaluation and the season backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import draws as D
from touchline.operators import evaluate as E
from touchline.plans import fixtures as fx
from touchline.plans.predict_queries import logpmf_sql
from touchline.plans.registry import query, sql, view
from touchline.plans.strength_queries import LR, PRIOR, fit_ctes, num, rounded, spaced

TRAIN_END = 200


def train():
    return F.col("cum_round") <= TRAIN_END


def test():
    return F.col("cum_round") > TRAIN_END


view("av", f"SELECT CAST(sum(goals) AS DOUBLE) / count(*) AS rate_home, CAST(sum(goals_against) AS DOUBLE) / count(*) AS rate_away FROM lr WHERE cum_round <= {TRAIN_END}")
view("ta", f"SELECT team, CAST(sum(goals) AS DOUBLE) / count(*) AS scored, CAST(sum(goals_against) AS DOUBLE) / count(*) AS conceded FROM lr WHERE cum_round <= {TRAIN_END} GROUP BY 1")
view("pm", "SELECT team_id AS team, avg(attack) AS attack, avg(defence) AS defence, avg(home_adv) AS home_adv FROM dr WHERE t = 4 GROUP BY 1")
view("pr", f"""SELECT lr.*, exp(greatest({num(-5.0)}, least({num(5.0)}, a.attack - b.defence + CASE WHEN is_home = 1 THEN a.home_adv ELSE 0 END + {num(0.2)} * ln(xg_c / 100.0::DOUBLE + {num(0.01)})))) AS lambda_home,
  exp(greatest({num(-5.0)}, least({num(5.0)}, b.attack - a.defence + {num(0.2)} * ln(xga_c / 100.0::DOUBLE + {num(0.01)})))) AS lambda_away
FROM lr JOIN pm a ON a.team = lr.team JOIN pm b ON b.team = lr.opp_team WHERE cum_round > {TRAIN_END}""")
PR = (*LR, "dr", "pm", "pr")
LL = f"({logpmf_sql('goals', 'lambda_home')} + {logpmf_sql('goals_against', 'lambda_away')})"


def predicted(spark, sf):
    """Test rounds predicted from the last step's mean strengths and the match's expected goals."""
    draws = fx.strength_draws(spark, sf).where(F.col("t") == 4)
    point = D.posterior_mean(draws, ["team_id"]).withColumnRenamed("team_id", "team")
    rows = fx.rounded_rows(spark, sf).where(test()).withColumns({"xG": F.col("xg_c") / 100, "xGA": F.col("xga_c") / 100})
    return E.strength_predictions(rows, point, xg_weight=0.2)


@query("naive_baseline", sql(f"""SELECT rate_home, rate_away, CAST(count(*) AS BIGINT) AS n_test, round(sum({logpmf_sql('goals', 'rate_home')} + {logpmf_sql('goals_against', 'rate_away')}), 4) AS log_likelihood,
  round(sum({logpmf_sql('goals', 'rate_home')} + {logpmf_sql('goals_against', 'rate_away')}) / (2 * count(*)), 6) AS ll_per_goal
FROM lr, av WHERE cum_round > {TRAIN_END} GROUP BY 1, 2""", *LR, "av"))
def naive_baseline(spark, sf):
    out = E.naive_baseline(fx.rounded_rows(spark, sf), train(), test())
    return rounded(rounded(out, "log_likelihood", digits=4), "ll_per_goal")


@query("team_average_baseline", sql(f"""CTE p AS (SELECT lr.*, (coalesce(a.scored, rate_home) + coalesce(b.conceded, rate_away)) / 2 AS lambda_home, (coalesce(b.scored, rate_away) + coalesce(a.conceded, rate_home)) / 2 AS lambda_away
  FROM lr LEFT JOIN ta a ON a.team = lr.team LEFT JOIN ta b ON b.team = lr.opp_team CROSS JOIN av WHERE cum_round > {TRAIN_END})
SELECT CAST(count(*) AS BIGINT) AS n_test, round(sum({LL}), 4) AS log_likelihood, round(sum({LL}) / (2 * count(*)), 6) AS ll_per_goal FROM p""", *LR, "av", "ta"))
def team_average_baseline(spark, sf):
    out = E.log_likelihood(E.team_average_predictions(fx.rounded_rows(spark, sf), train(), test()))
    return out.select("n_test", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("ll_per_goal", 6).alias("ll_per_goal"))


@query("mae", sql("""SELECT season, round(avg(abs(lambda_home - goals)), 6) AS mae_home, round(avg(abs(lambda_away - goals_against)), 6) AS mae_away,
  round((avg(abs(lambda_home - goals)) + avg(abs(lambda_away - goals_against))) / 2, 6) AS mae FROM pr GROUP BY 1""", *PR))
def mae(spark, sf):
    return rounded(E.mae(predicted(spark, sf), ["season"]), "mae_home", "mae_away", "mae")


@query("log_likelihood", sql(f"""SELECT season, round(sum({LL}), 4) AS log_likelihood, round(sum({LL}) / (2 * count(*)), 6) AS ll_per_goal, CAST(count(*) AS BIGINT) AS n_test FROM pr GROUP BY 1""", *PR))
def log_likelihood(spark, sf):
    out = E.log_likelihood(predicted(spark, sf), ["season"])
    return out.select("season", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("ll_per_goal", 6).alias("ll_per_goal"), "n_test")


@query("bayes_factor", sql(f"""CTE b AS (SELECT sum({logpmf_sql('goals', 'rate_home')} + {logpmf_sql('goals_against', 'rate_away')}) AS ll FROM lr, av WHERE cum_round > {TRAIN_END})
SELECT round((SELECT sum({LL}) FROM pr), 4) AS ll_model, round(ll, 4) AS ll_baseline, round((SELECT sum({LL}) FROM pr) - ll, 4) AS ll_improvement,
  round(((SELECT sum({LL}) FROM pr) - ll) / ln(10.0::DOUBLE), 4) AS log10_bayes_factor FROM b""", *PR, "av"))
def bayes_factor(spark, sf):
    base = E.naive_baseline(fx.rounded_rows(spark, sf), train(), test())
    out = E.bayes_factor(E.log_likelihood(predicted(spark, sf)), base).drop("bayes_factor")
    return rounded(out, *out.columns, digits=4)


@query("lambda_moments", sql("""SELECT round(avg(lambda_home), 6) AS home_mean, round(stddev_pop(lambda_home), 6) AS home_std, round(avg(lambda_away), 6) AS away_mean,
  round(stddev_pop(lambda_away), 6) AS away_std, round(CAST(sum(goals) AS DOUBLE) / count(*), 6) AS goals_home_mean, round(CAST(sum(goals_against) AS DOUBLE) / count(*), 6) AS goals_away_mean FROM pr""", *PR))
def lambda_moments(spark, sf):
    out = E.lambda_moments(predicted(spark, sf))
    return rounded(out, *out.columns)


@query("cv_windows", sql("""SELECT CAST(e - 24 AS INT) AS "window", 1 AS train_start, CAST(e AS INT) AS train_end, CAST(e + 1 AS INT) AS test_start, CAST(e + 5 AS INT) AS test_end
FROM (SELECT unnest(range(25, (SELECT max(cum_round) FROM mr) - 5 + 1, 1)) AS e) x""", "m", "wk", "rnd", "off", "cal", "mr"))
def cv_windows(spark, sf):
    return E.cv_windows(fx.rounded_matches(spark, sf), min_train=25, test_window=5, step=1)


@query("cv_window_sizes", sql("""CTE w AS (SELECT CAST(e AS INT) AS e FROM (SELECT unnest(range(25, (SELECT max(cum_round) FROM mr) - 1 + 1, 1)) AS e) x),
c AS (SELECT cum_round, count(*) AS n FROM mr GROUP BY 1)
SELECT e - 24 AS "window", e AS train_end, e + 1 AS test_start, e + 1 AS test_end, CAST(sum(CASE WHEN cum_round <= e THEN n ELSE 0 END) AS BIGINT) AS n_train,
  CAST(sum(CASE WHEN cum_round = e + 1 THEN n ELSE 0 END) AS BIGINT) AS n_test FROM w, c GROUP BY e""", "m", "wk", "rnd", "off", "cal", "mr"))
def cv_window_sizes(spark, sf):
    rows = fx.rounded_rows(spark, sf)
    return E.cv_window_sizes(rows, E.cv_windows(rows))


CV = f"""wn AS (SELECT CAST(e AS INT) AS cutoff FROM (SELECT unnest(range(25, (SELECT max(cum_round) FROM mr) - 1 + 1, 1)) AS e) x),
ss AS MATERIALIZED (SELECT cutoff, team, opp_team, is_home, CAST(count(*) AS DOUBLE) AS weight, CAST(sum(goals) AS DOUBLE) AS goals FROM lr JOIN wn ON cum_round <= cutoff GROUP BY 1, 2, 3, 4),
{fit_ctes(['cutoff'])},
sh AS (SELECT cutoff, max(ln(mu)) AS lv, max(ln(home)) AS hm FROM st GROUP BY 1),
nv AS (SELECT cutoff, CAST(sum(goals) AS DOUBLE) / count(*) AS naive, count(*) AS n_train FROM lr JOIN wn ON cum_round <= cutoff GROUP BY 1),
p AS (SELECT wn.cutoff, goals, goals_against, naive, n_train, exp(lv + coalesce(ln(a.att), 0) + coalesce(ln(b.dfn), 0) + hm * is_home) AS lambda_home,
  exp(lv + coalesce(ln(b.att), 0) + coalesce(ln(a.dfn), 0) + hm * (1 - is_home)) AS lambda_away
  FROM lr JOIN wn ON cum_round BETWEEN wn.cutoff + 1 AND wn.cutoff + 1 JOIN sh ON sh.cutoff = wn.cutoff JOIN nv ON nv.cutoff = wn.cutoff
  LEFT JOIN st a ON a.cutoff = wn.cutoff AND a.team = lr.team LEFT JOIN st b ON b.cutoff = wn.cutoff AND b.team = lr.opp_team),
cv AS (SELECT CAST(cutoff - 24 AS INT) AS "window", cutoff AS train_end, max(n_train) AS n_train, 2 * count(*) AS n_test,
  avg(abs(lambda_home - goals) + abs(lambda_away - goals_against)) / 2 AS mae, sum({LL}) AS log_likelihood,
  sum({logpmf_sql('goals', 'naive')} + {logpmf_sql('goals_against', 'naive')}) AS ll_naive FROM p GROUP BY cutoff)"""


def scores(spark, sf):
    rows = fx.rounded_rows(spark, sf)
    windows = E.cv_windows(rows, min_train=25, test_window=1, step=1)
    return E.cv_scores(rows, windows, prior=PRIOR)


@query("cv_scores", sql(f"""CTE {CV} SELECT "window", train_end, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, round(mae, 6) AS mae, round(log_likelihood, 4) AS log_likelihood,
  round(ll_naive, 4) AS ll_naive, round(log_likelihood - ll_naive, 4) AS ll_improvement FROM cv""", *LR, "mr", recursive=True))
def cv_scores(spark, sf):
    out = scores(spark, sf).drop("train_start", "test_start", "test_end")
    return rounded(rounded(out, "mae"), "log_likelihood", "ll_naive", "ll_improvement", digits=4)


@query("cv_summary", sql(f"""CTE {CV}, d AS (SELECT *, log_likelihood - ll_naive AS gain FROM cv)
SELECT round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_sd, round(min(mae), 6) AS mae_min, round(max(mae), 6) AS mae_max, round(avg(log_likelihood), 4) AS ll_mean,
  round(stddev_samp(log_likelihood), 4) AS ll_sd, round(avg(gain), 4) AS gain_mean, round(stddev_samp(gain), 4) AS gain_sd, round(min(gain), 4) AS gain_min, round(max(gain), 4) AS gain_max,
  bool_and(gain > 0) AS all_beat_naive FROM d""", *LR, "mr", recursive=True))
def cv_summary(spark, sf):
    out = E.cv_summary(scores(spark, sf))
    maes = [c for c in out.columns if c.startswith("mae")]
    return rounded(rounded(out, *maes), *[c for c in out.columns if c.startswith(("ll", "gain"))], digits=4)


BACK = f"""tg AS (SELECT CAST(unnest(range(2, (SELECT max(cum_round) FROM cal), 1)) AS INT) AS round),
pt AS (SELECT team, opp_team, is_home, cum_round AS t, count(*) AS n, sum(goals) AS g FROM lr GROUP BY 1, 2, 3, 4),
ss AS MATERIALIZED (SELECT round - 1 AS cutoff, team, opp_team, is_home, sum(pow({num(29.0 / 30.0)}, round - 1 - t) * n) AS weight, sum(pow({num(29.0 / 30.0)}, round - 1 - t) * g) AS goals
  FROM pt JOIN tg ON t <= round - 1 GROUP BY 1, 2, 3, 4),
{fit_ctes(['cutoff'])},
sh AS (SELECT cutoff, max(ln(mu)) AS lv, max(ln(home)) AS hm FROM st GROUP BY 1),
bt AS (SELECT cum_round AS round, match_no, mr.home AS home_team, away AS away_team, greatest({num(0.01)}, least({num(10.0)}, exp(lv + coalesce(ln(a.att), 0) + coalesce(ln(b.dfn), 0) + hm))) AS lambda_home,
  greatest({num(0.01)}, least({num(10.0)}, exp(lv + coalesce(ln(b.att), 0) + coalesce(ln(a.dfn), 0)))) AS lambda_away, goals_home, goals_away
  FROM mr JOIN tg ON cum_round = tg.round JOIN sh ON sh.cutoff = cum_round - 1 LEFT JOIN st a ON a.cutoff = cum_round - 1 AND a.team = mr.home LEFT JOIN st b ON b.cutoff = cum_round - 1 AND b.team = away)"""


def backtest(spark, sf):
    rounds = spaced(spark, sf, 2, 1)
    return E.season_backtest(fx.rounded_rows(spark, sf), rounds, prior=PRIOR, keep=["match_no"])


@query("season_backtest", sql(f"CTE {BACK} SELECT round, match_no, home_team, away_team, round(lambda_home, 6) AS lambda_home, round(lambda_away, 6) AS lambda_away, goals_home, goals_away FROM bt", *LR, "mr", recursive=True))
def season_backtest(spark, sf):
    return rounded(backtest(spark, sf), "lambda_home", "lambda_away")


@query("round_scorecard", sql(f"""CTE {BACK} SELECT round, round(avg(abs(lambda_home - goals_home)), 6) AS mae_home, round(avg(abs(lambda_away - goals_away)), 6) AS mae_away,
  round((avg(abs(lambda_home - goals_home)) + avg(abs(lambda_away - goals_away))) / 2, 6) AS mae, round(sum({logpmf_sql('goals_home', 'lambda_home')} + {logpmf_sql('goals_away', 'lambda_away')}), 4) AS log_likelihood,
  CAST(count(*) AS BIGINT) AS n_test FROM bt GROUP BY 1""", *LR, "mr", recursive=True))
def round_scorecard(spark, sf):
    stored = backtest(spark, sf).drop("goals_home", "goals_away")
    actual = fx.rounded_rows(spark, sf).where(F.col("is_home") == 1).select(
        "round", "match_no", F.col("goals").alias("goals_home"), F.col("goals_against").alias("goals_away"))
    out = E.round_scorecard(stored, actual, on=["round", "match_no"]).drop("ll_per_goal")
    return rounded(rounded(out, "mae_home", "mae_away", "mae"), "log_likelihood", digits=4)
