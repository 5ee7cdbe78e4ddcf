"""Scoring: baselines, errors, likelihoods and rolling-origin evaluation in one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import strength
from touchline.session import broadcast_within, small_side

LN10 = math.log(10.0)


def naive_baseline(
    rows: DataFrame, train: Column, test: Column, *, goals: tuple[str, str] = ("goals", "goals_against")
) -> DataFrame:
    """Constant rates from training means: log likelihood of the test rows, in total and per goal count.

    Test rows are counted per score first, so the log terms are evaluated once per distinct score.
    """
    own, other = goals
    means = rows.where(train).agg(F.avg(own).alias("rate_home"), F.avg(other).alias("rate_away"))  # one row
    scores = rows.where(test).groupBy(F.col(own).alias("_h"), F.col(other).alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    joined = scores.crossJoin(F.broadcast(means))
    ll = F.col("_n") * (S.poisson_logpmf(F.col("_h"), F.col("rate_home")) + S.poisson_logpmf(F.col("_a"), F.col("rate_away")))
    return joined.groupBy("rate_home", "rate_away").agg(
        F.sum(ll).alias("log_likelihood"), (F.sum(ll) / (2 * F.sum("_n"))).alias("ll_per_goal"), F.sum("_n").alias("n_test")
    )


def team_averages(rows: DataFrame, *, team: str = "team") -> DataFrame:
    return rows.groupBy(F.col(team).alias("team")).agg(F.avg("goals").alias("scored"), F.avg("goals_against").alias("conceded"))


def team_average_predictions(rows: DataFrame, train: Column, test: Column) -> DataFrame:
    """Rates from team averages, (scored[team] + conceded[opp]) / 2 and its mirror; unseen teams get the overall mean."""
    train_rows = rows.where(train)
    means = train_rows.agg(F.avg("goals").alias("_mh"), F.avg("goals_against").alias("_ma"))  # one row
    averages = small_side(team_averages(train_rows))
    own = averages.select("team", F.col("scored").alias("_ts"), F.col("conceded").alias("_tc"))
    opp = averages.select(F.col("team").alias("opp_team"), F.col("scored").alias("_os"), F.col("conceded").alias("_oc"))
    joined = rows.where(test).join(own, "team", "left").join(opp, "opp_team", "left").crossJoin(F.broadcast(means))
    home = (F.coalesce("_ts", "_mh") + F.coalesce("_oc", "_ma")) / 2
    away = (F.coalesce("_os", "_ma") + F.coalesce("_tc", "_mh")) / 2
    return joined.withColumns({"lambda_home": home, "lambda_away": away}).drop("_ts", "_tc", "_os", "_oc", "_mh", "_ma")


def strength_predictions(rows: DataFrame, strengths: DataFrame, *, xg_weight: float | None = None, xg: tuple[str, str] = ("xG", "xGA")) -> DataFrame:
    """Rates from point strengths (team, attack, defence, home_adv), log rates clipped hard.

    Teams without strengths get the mean over teams, so every row is predicted and scored.
    `xg_weight` adds the match's own expected goals, which makes it a description, not a forecast.
    """
    point = small_side(strengths.select("team", "attack", "defence", "home_adv"))
    mean = point.agg(*[F.avg(c).alias(f"_m{c}") for c in ("attack", "defence", "home_adv")])  # one row
    own = point.withColumnsRenamed({"attack": "_ta", "defence": "_td", "home_adv": "_th"})
    opp = point.select(F.col("team").alias("opp_team"), F.col("attack").alias("_oa"), F.col("defence").alias("_od"))
    ta, td, th = F.coalesce("_ta", "_mattack"), F.coalesce("_td", "_mdefence"), F.coalesce("_th", "_mhome_adv")
    oa, od = F.coalesce("_oa", "_mattack"), F.coalesce("_od", "_mdefence")
    home = ta - od + F.when(F.col("is_home") == 1, th).otherwise(0.0)
    away = oa - td
    if xg_weight is not None:
        home = home + F.lit(float(xg_weight)) * S.log_xg(F.col(xg[0]))
        away = away + F.lit(float(xg_weight)) * S.log_xg(F.col(xg[1]))
    joined = rows.join(own, "team", "left").join(opp, "opp_team", "left").crossJoin(F.broadcast(mean))
    return joined.withColumns(
        {"lambda_home": F.exp(S.hard_clip(home, *S.LOG_RATE_BOUNDS)), "lambda_away": F.exp(S.hard_clip(away, *S.LOG_RATE_BOUNDS))}
    ).drop("_ta", "_td", "_th", "_oa", "_od", "_mattack", "_mdefence", "_mhome_adv")


def mae(predicted: DataFrame, by: Sequence[str] = (), goals: tuple[str, str] = ("goals", "goals_against")) -> DataFrame:
    """Mean absolute error for home, away and both."""
    out = predicted.groupBy(*by).agg(
        F.avg(F.abs(F.col("lambda_home") - F.col(goals[0]))).alias("mae_home"),
        F.avg(F.abs(F.col("lambda_away") - F.col(goals[1]))).alias("mae_away"),
    )
    return out.withColumn("mae", (F.col("mae_home") + F.col("mae_away")) / 2)


def row_loglik(goals: tuple[str, str] = ("goals", "goals_against")) -> Column:
    return S.poisson_logpmf(F.col(goals[0]), F.col("lambda_home")) + S.poisson_logpmf(F.col(goals[1]), F.col("lambda_away"))


def log_likelihood(predicted: DataFrame, by: Sequence[str] = (), goals: tuple[str, str] = ("goals", "goals_against")) -> DataFrame:
    return predicted.groupBy(*by).agg(
        F.sum(row_loglik(goals)).alias("log_likelihood"),
        (F.sum(row_loglik(goals)) / (2 * F.count(F.lit(1)))).alias("ll_per_goal"),
        F.count(F.lit(1)).alias("n_test"),
    )


def bayes_factor(model: DataFrame, baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log-likelihood gain and Bayes factor exp(gain); log10 as well, since the factor overflows early."""
    m = model.select(*by, F.col("log_likelihood").alias("ll_model"))
    b = baseline.select(*by, F.col("log_likelihood").alias("ll_baseline"))
    joined = m.join(b, list(by)) if by else m.crossJoin(F.broadcast(b))  # one row each
    gain = F.col("ll_model") - F.col("ll_baseline")
    return joined.withColumns({"ll_improvement": gain, "bayes_factor": F.exp(gain), "log10_bayes_factor": gain / F.lit(LN10)})


def lambda_moments(predicted: DataFrame, goals: tuple[str, str] = ("goals", "goals_against")) -> DataFrame:
    return predicted.agg(
        F.avg("lambda_home").alias("home_mean"), F.stddev_pop("lambda_home").alias("home_std"),
        F.avg("lambda_away").alias("away_mean"), F.stddev_pop("lambda_away").alias("away_std"),
        F.avg(goals[0]).alias("goals_home_mean"), F.avg(goals[1]).alias("goals_away_mean"),
    )


def cv_windows(rows: DataFrame, *, min_train: int = 25, test_window: int = 1, step: int = 1, t: str = "cum_round") -> DataFrame:
    """Expanding windows: train on rounds 1..train_end, test on the next `test_window` rounds."""
    last = rows.agg((F.max(t) - test_window).alias("_last")).where(F.col("_last") >= min_train)
    end = F.explode(F.sequence(F.lit(min_train), F.col("_last").cast("int"), F.lit(step)))
    w = last.select(end.alias("train_end"))
    return w.select(
        ((F.col("train_end") - min_train) / step + 1).cast("int").alias("window"), F.lit(1).alias("train_start"), "train_end",
        (F.col("train_end") + 1).alias("test_start"), (F.col("train_end") + test_window).alias("test_end"),
    )


def per_window(rows: DataFrame, windows: DataFrame, t: str = "cum_round") -> DataFrame:
    """Per window: training rows and goals, test rows. Rows are first reduced to one per round."""
    by_round = rows.groupBy(F.col(t).alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.sum("goals").alias("_g"))
    spread = windows.withColumn("_t", F.explode(F.sequence(F.col("train_start"), F.col("test_end"))))
    train = F.col("_t") <= F.col("train_end")
    return spread.join(by_round, "_t", "left").groupBy("window", "train_start", "train_end", "test_start", "test_end").agg(
        F.coalesce(F.sum(F.when(train, F.col("_n"))), F.lit(0)).alias("_train_rows"),
        F.coalesce(F.sum(F.when(train, F.col("_g"))), F.lit(0)).alias("_train_goals"),
        F.coalesce(F.sum(F.when(~train, F.col("_n"))), F.lit(0)).alias("_test_rows"),
    )


def cv_window_sizes(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Matches (half the team rows) in the training and test part of each window."""
    return per_window(rows, windows).select(
        "window", "train_end", "test_start", "test_end",
        F.floor(F.col("_train_rows") / 2).alias("n_train"), F.floor(F.col("_test_rows") / 2).alias("n_test"),
    )


def cv_scores(
    rows: DataFrame, windows: DataFrame, *, decay: float = 1.0, prior: float = 5.0, steps: int = 200, tolerance: float = 1e-10,
    xg_weight: float | None = None, xg: tuple[str, str] = ("xG", "xGA"),
) -> DataFrame:
    """Fit every window, predict its test rounds and score them, with no loop over windows.

    The window's last training round is part of the fit's group key. Windows number at most one per
    round, so their list fits the driver.
    """
    cutoffs = [r["train_end"] for r in windows.select("train_end").collect()]
    stats = strength.stats_until(rows, cutoffs, decays={"all": decay}).drop("decay")
    fit = strength.fit_strengths(stats, ["cutoff"], prior=prior, steps=steps, tolerance=tolerance)
    fit = broadcast_within(fit)
    shared = fit.groupBy("cutoff").agg(F.max("level").alias("_level"), F.max("home").alias("_home"))
    own = fit.select(F.col("cutoff").alias("train_end"), "team", F.col("attack").alias("_ta"), F.col("defence").alias("_td"))
    opp = fit.select(F.col("cutoff").alias("train_end"), F.col("team").alias("opp_team"), F.col("attack").alias("_oa"), F.col("defence").alias("_od"))
    sizes = per_window(rows, windows).withColumn("_naive", F.try_divide("_train_goals", "_train_rows"))
    context = sizes.join(shared, sizes["train_end"] == shared["cutoff"]).drop("cutoff")
    # At most one row per window and test round: bounded by the calendar.
    tested = F.broadcast(context.withColumn("cum_round", F.explode(F.sequence("test_start", "test_end"))))
    zero = F.lit(0.0)
    joined = rows.join(tested, "cum_round").join(own, ["train_end", "team"], "left").join(opp, ["train_end", "opp_team"], "left")
    home = F.col("_level") + F.coalesce("_ta", zero) - F.coalesce("_od", zero) + F.col("_home") * F.col("is_home")
    away = F.col("_level") + F.coalesce("_oa", zero) - F.coalesce("_td", zero) + F.col("_home") * (1 - F.col("is_home"))
    if xg_weight is not None:
        home = home + F.lit(float(xg_weight)) * S.log_xg(F.col(xg[0]))
        away = away + F.lit(float(xg_weight)) * S.log_xg(F.col(xg[1]))
    predicted = joined.withColumns(
        {"lambda_home": F.exp(S.hard_clip(home, *S.LOG_RATE_BOUNDS)), "lambda_away": F.exp(S.hard_clip(away, *S.LOG_RATE_BOUNDS))}
    )
    naive = S.poisson_logpmf(F.col("goals"), F.col("_naive")) + S.poisson_logpmf(F.col("goals_against"), F.col("_naive"))
    error = F.abs(F.col("lambda_home") - F.col("goals")) + F.abs(F.col("lambda_away") - F.col("goals_against"))
    out = predicted.groupBy("window", "train_start", "train_end", "test_start", "test_end").agg(
        F.max("_train_rows").alias("n_train"), (2 * F.count(F.lit(1))).alias("n_test"),
        (F.avg(error) / 2).alias("mae"), F.sum(row_loglik()).alias("log_likelihood"), F.sum(naive).alias("ll_naive"),
    )
    return out.withColumn("ll_improvement", F.col("log_likelihood") - F.col("ll_naive"))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over windows, ranges, and whether every window beats the baseline."""
    return scores.agg(
        F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_sd"), F.min("mae").alias("mae_min"), F.max("mae").alias("mae_max"),
        F.avg("log_likelihood").alias("ll_mean"), F.stddev_samp("log_likelihood").alias("ll_sd"),
        F.avg("ll_improvement").alias("gain_mean"), F.stddev_samp("ll_improvement").alias("gain_sd"),
        F.min("ll_improvement").alias("gain_min"), F.max("ll_improvement").alias("gain_max"),
        F.bool_and(F.col("ll_improvement") > 0).alias("all_beat_naive"),
    )


def season_backtest(
    rows: DataFrame, rounds: Sequence[int], *, decay: float = 29.0 / 30.0, prior: float = 5.0, steps: int = 200, tolerance: float = 1e-10,
    keep: Sequence[str] = ("match_id",),
) -> DataFrame:
    """For every listed round N: strengths from rounds before N, rates for the matches of N. One job."""
    wanted = sorted(set(rounds))
    stats = strength.stats_until(rows, [n - 1 for n in wanted], decays={"all": decay}).drop("decay")
    fit = broadcast_within(strength.fit_strengths(stats, ["cutoff"], prior=prior, steps=steps, tolerance=tolerance))
    shared = F.broadcast(fit.groupBy("cutoff").agg(F.max("level").alias("_level"), F.max("home").alias("_home")))  # one row per round
    own = fit.select("cutoff", "team", F.col("attack").alias("_ta"), F.col("defence").alias("_td"))
    opp = fit.select("cutoff", F.col("team").alias("opp_team"), F.col("attack").alias("_oa"), F.col("defence").alias("_od"))
    hosts = rows.where((F.col("is_home") == 1) & F.col("round").isin(wanted)).withColumn("cutoff", F.col("round") - 1)
    zero = F.lit(0.0)
    joined = hosts.join(shared, "cutoff").join(own, ["cutoff", "team"], "left").join(opp, ["cutoff", "opp_team"], "left")
    home = F.exp(F.col("_level") + F.coalesce("_ta", zero) - F.coalesce("_od", zero) + F.col("_home"))
    away = F.exp(F.col("_level") + F.coalesce("_oa", zero) - F.coalesce("_td", zero))
    return joined.select(
        "round", *keep, F.col("team").alias("home_team"), F.col("opp_team").alias("away_team"),
        S.hard_clip(home, *S.RATE_BOUNDS).alias("lambda_home"), S.hard_clip(away, *S.RATE_BOUNDS).alias("lambda_away"),
        F.col("goals").alias("goals_home"), F.col("goals_against").alias("goals_away"),
    )


def round_scorecard(predictions: DataFrame, actuals: DataFrame | None = None, on: Sequence[str] = ("round", "match_id")) -> DataFrame:
    """Error and likelihood per stored round; `actuals` are joined unless the scores are on the rows."""
    both = predictions if actuals is None else predictions.join(actuals, list(on))
    goals = ("goals_home", "goals_away")
    return mae(both, ["round"], goals).join(log_likelihood(both, ["round"], goals), "round")
