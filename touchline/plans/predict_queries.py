"""Queries: draws, goal rates, scorelines and prediction records."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import draws as D
from touchline.operators import predict as P
from touchline.plans import fixtures as fx
from touchline.plans.registry import query, sql, view
from touchline.plans.strength_queries import num, rounded

RATES = ("m", "dr", "fx", "rates")


def rates(spark, sf):
    return P.goal_rates(fx.pairings(spark, sf), fx.strength_draws(spark, sf))


def logpmf_sql(k: str, rate: str) -> str:
    return f"({k} * ln({rate}) - {rate} - lgamma({k} + 1))"


@query("draws_long", """SELECT vec_id, CAST(k AS INT) AS team_id, CAST(embedding[k + 1] AS DOUBLE) AS attack, CAST(embedding[k + 33] AS DOUBLE) AS defence
FROM embeddings, (SELECT unnest(range(32)) AS k) ks""")
def draws_long(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("d"))
    return D.explode_draws(e, {"a": "attack", "d": "defence"}, keep=["vec_id"])


@query("posterior_mean", sql("""SELECT t, team_id, round(avg(attack), 6) AS attack, round(avg(defence), 6) AS defence, round(avg(home_adv), 6) AS home_adv FROM dr GROUP BY 1, 2""", "dr"))
def posterior_mean(spark, sf):
    return rounded(D.posterior_mean(fx.strength_draws(spark, sf)), "attack", "defence", "home_adv")


@query("team_strengths", sql("""CTE x AS (SELECT 'attack' AS param, team_id, t, attack AS v FROM dr UNION ALL SELECT 'defence', team_id, t, defence FROM dr
  UNION ALL SELECT 'home_adv', team_id, -1, max(home_adv) FROM dr GROUP BY team_id, chain, draw),
s AS (SELECT param, team_id, t, avg(v) AS mean, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM x GROUP BY 1, 2, 3)
SELECT param, team_id, t, round(mean, 6) AS mean, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM s""", "dr"))
def team_strengths(spark, sf):
    return rounded(D.team_strengths(fx.strength_draws(spark, sf)), "mean", "p5", "p95")


@query("ar1_path", sql(f"""CTE p AS (SELECT chain, draw, team_id, t, {num(0.2)} * attack AS x FROM dr WHERE t = 0
  UNION ALL SELECT d.chain, d.draw, d.team_id, d.t, {num(0.9)} * p.x + {num(0.05)} * d.attack FROM p JOIN dr d ON d.chain = p.chain AND d.draw = p.draw AND d.team_id = p.team_id AND d.t = p.t + 1)
SELECT chain, draw, team_id, t, round(x, 8) AS x FROM p""", "dr", recursive=True))
def ar1_path(spark, sf):
    noise = fx.strength_draws(spark, sf).select("chain", "draw", "team_id", "t", F.col("attack").alias("z"))
    out = D.ar1_path(noise, rho=0.9, sigma=0.05, init_scale=0.2)
    return out.select("chain", "draw", "team_id", "t", F.round("x", 8).alias("x"))


@query("centre_over_teams", sql("""SELECT chain, draw, t, team_id, round(attack - avg(attack) OVER w, 8) AS attack, round(defence - avg(defence) OVER w, 8) AS defence
FROM dr WINDOW w AS (PARTITION BY chain, draw, t)""", "dr"))
def centre_over_teams(spark, sf):
    out = D.centre_over_teams(fx.strength_draws(spark, sf))
    return rounded(out.drop("home_adv"), "attack", "defence", digits=8)


@query("drift_penalty", sql("""CTE a AS (SELECT chain, draw, t, avg(attack) AS a, avg(defence) AS d FROM dr GROUP BY 1, 2, 3)
SELECT chain, draw, round(sum(-pow(a / 0.5::DOUBLE, 2) / 2 - ln(0.5::DOUBLE) - 0.5::DOUBLE * ln(2 * pi())), 6) AS penalty_attack,
  round(sum(-pow(d / 0.5::DOUBLE, 2) / 2 - ln(0.5::DOUBLE) - 0.5::DOUBLE * ln(2 * pi())), 6) AS penalty_defence FROM a GROUP BY 1, 2""", "dr"))
def drift_penalty(spark, sf):
    return rounded(D.drift_penalty(fx.strength_draws(spark, sf), 0.5), "penalty_attack", "penalty_defence")


@query("goal_rates", sql("SELECT match_id, chain, draw, round(lambda_home, 8) AS lambda_home, round(lambda_away, 8) AS lambda_away FROM rates", *RATES))
def goal_rates(spark, sf):
    return rounded(rates(spark, sf), "lambda_home", "lambda_away", digits=8)


@query("draw_subsample", sql("""CTE u AS (SELECT match_id, chain, draw, substr(md5('42|' || match_id || '|' || chain || '|' || draw), 1, 13) AS u FROM rates),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY u, chain, draw) AS rn FROM u)
SELECT match_id, chain, draw FROM r WHERE rn <= 40""", *RATES))
def draw_subsample(spark, sf):
    return D.subsample(rates(spark, sf), 40).select("match_id", "chain", "draw")


@query("expected_goals_summary", sql("""CTE x AS (SELECT match_id, 'home' AS side, lambda_home AS v FROM rates UNION ALL SELECT match_id, 'away', lambda_away FROM rates)
SELECT match_id, side, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.95), 6) AS p95 FROM x GROUP BY 1, 2""", *RATES))
def expected_goals_summary(spark, sf):
    return rounded(P.rate_summary(rates(spark, sf)).drop("n_draws"), "mean", "std", "p5", "median", "p95")


def grid_view(top: int) -> str:
    return f"""SELECT match_id, h, a, avg(exp({logpmf_sql('h', 'lambda_home')} + {logpmf_sql('a', 'lambda_away')})) AS p
FROM rates, (SELECT CAST(unnest(range({top + 1})) AS INT) AS h) hs, (SELECT CAST(unnest(range({top + 1})) AS INT) AS a) az GROUP BY 1, 2, 3"""


view("grid", grid_view(P.CLIPPED_GOALS))
view("corner", grid_view(10))


@query("score_distribution", sql("SELECT match_id, h AS home_goals, a AS away_goals, round(p, 7) AS probability, round(greatest(1 - sum(p) OVER (PARTITION BY match_id), 0), 6) AS tail FROM corner", *RATES, "corner"))
def score_distribution(spark, sf):
    """Scores up to 10 goals a side, and the probability of all others as `tail`."""
    return rounded(rounded(P.score_grid(rates(spark, sf), 10), "probability", digits=7), "tail")


@query("outcome_probabilities", sql("""SELECT match_id, round(sum(CASE WHEN h > a THEN p ELSE 0 END), 6) AS home_win, round(sum(CASE WHEN h = a THEN p ELSE 0 END), 6) AS draw,
  round(sum(CASE WHEN h < a THEN p ELSE 0 END), 6) AS away_win FROM grid GROUP BY 1""", *RATES, "grid"))
def outcome_probabilities(spark, sf):
    out = P.outcome_probabilities(rates(spark, sf))
    return rounded(out, "home_win", "draw", "away_win")


@query("top_scores", sql("""CTE r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 6) DESC, h, a) AS rank FROM grid)
SELECT match_id, CAST(rank AS INT) AS rank, h || '-' || a AS score, round(p, 6) AS probability FROM r WHERE rank <= 10""", *RATES, "grid"))
def top_scores(spark, sf):
    return rounded(P.top_scores(P.score_grid(rates(spark, sf))), "probability")


def _figures(side: str) -> str:
    v = f"lambda_{side}"
    return (f"round(avg({v}), 2) AS mean_{side}, round(quantile_cont({v}, 0.5), 2) AS median_{side}, round(stddev_pop({v}), 2) AS std_{side}, "
            f"round(quantile_cont({v}, 0.05), 2) AS p5_{side}, round(quantile_cont({v}, 0.95), 2) AS p95_{side}")


FIGURES = ", ".join(f"{c}_{side}" for side in ("home", "away") for c in ("mean", "median", "std", "p5", "p95"))


@query("prediction_records", sql(f"""CTE e AS (SELECT match_id, count(*) AS n_draws, {_figures('home')}, {_figures('away')} FROM rates GROUP BY 1),
o AS (SELECT match_id, round(sum(CASE WHEN h > a THEN p ELSE 0 END), 4) AS home_win, round(sum(CASE WHEN h = a THEN p ELSE 0 END), 4) AS draw,
  round(sum(CASE WHEN h < a THEN p ELSE 0 END), 4) AS away_win FROM grid GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 6) DESC, h, a) AS rank FROM grid),
s AS (SELECT match_id, string_agg(h || '-' || a, ',' ORDER BY rank) AS scores, round(sum(round(p, 4)), 4) AS scores_total FROM r WHERE rank <= 10 GROUP BY 1)
SELECT match_id, round, home_id AS home_team, away_id AS away_team, n_draws, {FIGURES}, home_win, draw, away_win, scores, scores_total
FROM fx JOIN e USING (match_id) JOIN o USING (match_id) JOIN s USING (match_id)""", *RATES, "grid"))
def prediction_records(spark, sf):
    out = P.prediction_records(fx.pairings(spark, sf), rates(spark, sf))
    parts = {"mean": "mean", "median": "median", "std": "std", "p5": "percentile_5", "p95": "percentile_95"}
    total = F.aggregate("most_likely_scores", F.lit(0.0), lambda t, s: t + s["probability"])
    return out.select(
        "match_id", "round", "home_team", "away_team", "n_draws",
        *[F.col(f"expected_goals_{side}.{field}").alias(f"{c}_{side}") for side in ("home", "away") for c, field in parts.items()],
        "outcome_probabilities.home_win", "outcome_probabilities.draw", "outcome_probabilities.away_win",
        F.array_join(F.transform("most_likely_scores", lambda s: s["score"]), ",").alias("scores"), F.round(total, 4).alias("scores_total"),
    )


# Observations: both perspectives of every meeting, alike ones counted once.
view("ob", """SELECT least(CAST(season AS INT) - 1995, 4) AS t, team AS team_id, opp_team AS opp_id, is_home, goals, goals_against, CAST(count(*) AS BIGINT) AS n_obs,
  CAST(sum(xg_c) AS BIGINT) AS xg, CAST(sum(xga_c) AS BIGINT) AS xga FROM l GROUP BY 1, 2, 3, 4, 5, 6""")
view("obm", """SELECT t, team_id, opp_id, is_home, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM ob GROUP BY 1, 2, 3, 4""")
OBS = ("m", "l0", "l", "dr", "ob")


def observations(spark, sf):
    """One row per (t, team, opponent, home): mean expected goals and the scores seen, each with its count."""
    rows = fx.team_rows(spark, sf).withColumn("t", F.least(F.col("season").cast("int") - 1995, F.lit(4)))
    keys = ["t", "team_id", "opp_id", "is_home"]
    by_score = rows.groupBy("t", F.col("team").alias("team_id"), F.col("opp_team").alias("opp_id"), "is_home",
                            F.col("goals").alias("goals_home"), F.col("goals_against").alias("goals_away")).agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("xg_c").alias("_x"), F.sum("xga_c").alias("_y"))
    n = F.sum("n_obs")
    return by_score.groupBy(*keys).agg(
        (F.sum("_x").cast("double") / n / 100).alias("xG_home"), (F.sum("_y").cast("double") / n / 100).alias("xG_away"),
        # At most one entry per distinct score.
        F.collect_list(F.struct("goals_home", "goals_away", "n_obs")).alias("scores"),
    ).withColumn("home", F.col("is_home"))


def key_columns(df):
    """Observation key kept apart from the join columns."""
    return df.withColumn("obs_id", (F.col("t") * 100000 + F.col("team_id") * 1000 + F.col("opp_id") * 10 + F.col("is_home")).cast("long"))


OBS_ID = "CAST(o.t * 100000 + o.team_id * 1000 + o.opp_id * 10 + o.is_home AS BIGINT)"
PAIR = """JOIN dr h ON h.t = o.t AND h.team_id = o.team_id JOIN dr a ON a.t = h.t AND a.chain = h.chain AND a.draw = h.draw AND a.team_id = o.opp_id"""


@query("linear_predictor", sql(f"""CTE o AS (SELECT t, team_id, opp_id, is_home, CAST(sum(xg) AS DOUBLE) / sum(n_obs) / 100 AS xg, CAST(sum(xga) AS DOUBLE) / sum(n_obs) / 100 AS xga FROM ob GROUP BY 1, 2, 3, 4),
e AS (SELECT {OBS_ID} AS obs_id, h.chain, h.draw, h.attack - a.defence + h.home_adv * o.is_home + {num(0.9)} * ln(xg + {num(0.01)}) AS th, a.attack - h.defence + {num(0.9)} * ln(xga + {num(0.01)}) AS ta FROM o {PAIR})
SELECT obs_id, chain, draw, round({num(2.0)} * tanh(th / {num(2.0)}), 6) AS theta_home, round({num(2.0)} * tanh(ta / {num(2.0)}), 6) AS theta_away FROM e""", *OBS))
def linear_predictor(spark, sf):
    obs = key_columns(observations(spark, sf)).drop("scores", "is_home")
    out = P.linear_predictor(obs, fx.strength_draws(spark, sf), xg_weight=0.9, clip=2.0)
    return rounded(out.drop("lambda_home", "lambda_away"), "theta_home", "theta_away")


@query("opponent_adjusted_xg", sql(f"""CTE o AS (SELECT t, team_id, opp_id, is_home, CAST(sum(xg) AS DOUBLE) / sum(n_obs) / 100 AS xg, CAST(sum(xga) AS DOUBLE) / sum(n_obs) / 100 AS xga FROM ob GROUP BY 1, 2, 3, 4),
e AS (SELECT {OBS_ID} AS obs_id, h.attack - a.defence + h.home_adv * o.is_home + {num(0.9)} * greatest({num(0.5)}, least({num(1.5)}, 1 + {num(0.3)} * a.defence)) * ln(xg + {num(0.01)}) AS th,
  a.attack - h.defence + {num(0.9)} * greatest({num(0.5)}, least({num(1.5)}, 1 + {num(0.3)} * h.defence)) * ln(xga + {num(0.01)}) AS ta FROM o {PAIR})
SELECT obs_id, round(avg(exp({num(2.0)} * tanh(th / {num(2.0)}))), 6) AS pred_home, round(avg(exp({num(2.0)} * tanh(ta / {num(2.0)}))), 6) AS pred_away FROM e GROUP BY 1""", *OBS))
def opponent_adjusted_xg(spark, sf):
    obs = key_columns(observations(spark, sf)).drop("scores", "is_home")
    out = P.linear_predictor(obs, fx.strength_draws(spark, sf), xg_weight=0.9, adjustment=0.3, clip=2.0)
    return rounded(P.posterior_predictive_mean(out), "pred_home", "pred_away")


@query("posterior_predictive_mean", sql(f"""CTE e AS (SELECT {OBS_ID} AS obs_id, h.attack - a.defence + h.home_adv * o.is_home AS th, a.attack - h.defence AS ta FROM obm o {PAIR})
SELECT obs_id, round(avg(exp({num(2.0)} * tanh(th / {num(2.0)}))), 6) AS pred_home, round(avg(exp({num(2.0)} * tanh(ta / {num(2.0)}))), 6) AS pred_away FROM e GROUP BY 1""", *OBS, "obm"))
def posterior_predictive_mean(spark, sf):
    obs = key_columns(observations(spark, sf)).drop("scores", "is_home")
    out = P.linear_predictor(obs, fx.strength_draws(spark, sf), clip=2.0)
    return rounded(P.posterior_predictive_mean(out), "pred_home", "pred_away")


@query("pointwise_loglik", sql(f"""CTE e AS (SELECT {OBS_ID} AS obs_id, goals, goals_against, n_obs, exp({num(2.0)} * tanh((h.attack - a.defence + h.home_adv * o.is_home) / {num(2.0)})) AS lh,
  exp({num(2.0)} * tanh((a.attack - h.defence) / {num(2.0)})) AS la FROM ob o {PAIR})
SELECT obs_id, goals AS goals_home, goals_against AS goals_away, n_obs, round(ln(avg(exp({logpmf_sql('goals', 'lh')} + {logpmf_sql('goals_against', 'la')}))), 6) AS log_mean_likelihood,
  round(avg({logpmf_sql('goals', 'lh')} + {logpmf_sql('goals_against', 'la')}), 6) AS mean_loglik FROM e GROUP BY 1, 2, 3, 4""", *OBS))
def pointwise_loglik(spark, sf):
    obs = key_columns(observations(spark, sf)).drop("is_home")
    rates = P.linear_predictor(obs, fx.strength_draws(spark, sf), clip=2.0)
    by = ["obs_id", "goals_home", "goals_away", "n_obs"]
    out = P.pointwise_loglik(rates.select("obs_id", "lambda_home", "lambda_away", F.inline("scores")), by)
    return rounded(out, "log_mean_likelihood", "mean_loglik")


@query("soft_clip", f"""SELECT o_orderkey, round({num(2.0)} * tanh((o_totalprice / 100000.0::DOUBLE - 2) / {num(2.0)}), 8) AS clipped FROM orders""")
def soft_clip(spark, sf):
    x = F.col("o_totalprice") / 100000.0 - 2
    return fx.table(spark, sf, "orders").select("o_orderkey", F.round(S.soft_clip(x, 2.0), 8).alias("clipped"))


@query("poisson_logpmf", f"""SELECT l_orderkey, l_linenumber, round({logpmf_sql('l_quantity', '(1 + l_extendedprice / 10000)')}, 6) AS logpmf FROM lineitem""")
def poisson_logpmf(spark, sf):
    pmf = S.poisson_logpmf(F.col("l_quantity").cast("int"), 1 + F.col("l_extendedprice") / 10000)
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(pmf, 6).alias("logpmf"))
