"""End-to-end jobs: prepare matches, train up to a moment, predict the next round, backtest a season.

Each takes tables and an explicit `as_of`; none reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.functions.config import StrengthConfig
from touchline.operators import draws as D
from touchline.operators import obs, predict, reshape, rounds, strength
from touchline.sources import store
from touchline.session import settle


def prepare(raw: DataFrame, keep: Sequence[str] = ("season",), group: Sequence[str] = ()) -> DataFrame:
    """Feed records -> team rows with rounds, match ids and perspective columns.

    With a `group` (such as the league) every group has its own calendar of rounds.
    """
    rows = reshape.team_matches(raw, [*keep, *[c for c in group if c not in keep]])
    rows = rounds.add_match_ids(rounds.add_rounds(rows, group))
    return reshape.perspective_columns(rows)


def played(rows: DataFrame) -> DataFrame:
    """Without matches that have no result: those are kept as 0-0 with `is_played` 0."""
    return rows.where(F.col("is_played") == 1) if "is_played" in rows.columns else rows


def strength_table(rows: DataFrame, cutoffs: Sequence[int], config: StrengthConfig, group: Sequence[str] = ()) -> DataFrame:
    """Draws table from bootstrap fits, one time step per cut-off round; a fit per `group`, whose teams must differ.

    Every replicate has every team that played by the cut-off.
    """
    fanned = played(rows).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(config.replicates))))
    weight = S.poisson_one(S.mixed_uniform(config.seed, F.col("match_id"), F.col("replicate")))
    drawn = fanned.withColumn("_weight", weight)
    stats = strength.stats_until(drawn, cutoffs, decays={"all": config.fit_decay}, group=[*group, "replicate"], weight=F.col("_weight"))
    fit = strength.home_advantage(
        stats.drop("decay"), [*group, "replicate", "cutoff"], prior=config.prior_weight, pool=config.home_prior_weight,
        steps=config.steps, tolerance=config.tolerance,
    )
    return fit.select(
        F.lit(0).alias("chain"), F.col("replicate").alias("draw"), F.col("cutoff").alias("t"), F.col("team").alias("team_id"),
        (F.col("attack") + F.col("level")).alias("attack"), "defence", "home_adv",
    )


def fixtures_of(rows: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """One row per match of the given rounds."""
    hosts = rows.where((F.col("is_home") == 1) & F.col("round").isin([int(r) for r in wanted]))
    return hosts.select("match_id", "round", F.col("team").alias("home_id"), F.col("opp_team").alias("away_id"))


def train(
    rows: DataFrame, as_of: Column, run_id: str, root: str, config: StrengthConfig = StrengthConfig(), group: Sequence[str] = ()
) -> int:
    """Fit on rounds before the next one and store draws, observations, teams and a registry row."""
    target = rounds.require_next_round(rows, as_of)
    past = played(rows).where(F.col("round") <= target - 1)
    index = reshape.team_index(rows)
    tables = {
        "draws": strength_table(past, [target - 1], config, group),
        "observations": obs.observations(played(rows), index, target - 1),
        "teams": index,
        "runs": past.agg(
            F.count(F.lit(1)).alias("n_obs"), F.count_distinct("match_id").alias("n_matches"), F.count_distinct("team").alias("n_teams")
        ).select("*", F.lit(target - 1).alias("trained_to_round"), F.lit(target).alias("next_round"), as_of.alias("created_at")),
    }
    store.save_run(root, run_id, tables)
    return target


def predict_next(rows: DataFrame, as_of: Column, draws: DataFrame, config: StrengthConfig = StrengthConfig()) -> DataFrame:
    """Prediction records for the next round from stored draws."""
    target = rounds.require_next_round(rows, as_of)
    return predict_rounds(rows, [target], draws, config)


def predict_rounds(rows: DataFrame, wanted: Sequence[int], draws: DataFrame, config: StrengthConfig) -> DataFrame:
    fixtures = fixtures_of(rows, wanted)
    rates = predict.goal_rates(fixtures, draws)
    scored = D.subsample(rates, config.sample_draws, seed=config.seed) if config.sample_draws else None
    return predict.prediction_records(
        fixtures, rates, max_goals=config.max_goals, k=config.top_scores, scored=scored
    )


def fitted_rates(observations: DataFrame, draws: DataFrame, config: StrengthConfig = StrengthConfig()) -> DataFrame:
    """Training-form rates of every (observation, draw) under the configured terms."""
    return predict.linear_predictor(
        observations, draws, clip=config.clip_theta, xg_weight=config.xg_weight if config.use_xg else None,
        adjustment=config.xg_adjustment_strength if config.use_opponent_adjusted_xg else None,
    )


def backtest_season(
    rows: DataFrame,
    as_of: Column,
    root: str,
    *,
    start_round: int = 2,
    end_round: int | None = None,
    skip_rounds: Sequence[int] = (),
    step: int = 1,
    skip_existing: bool = False,
    config: StrengthConfig = StrengthConfig(),
    group: Sequence[str] = (),
) -> list[int]:
    """Predict every selected completed round from the rounds before it and store the results by round.

    All rounds are fitted and predicted in one job: the cut-off is the time step of the draws. Each
    table is one partitioned write that replaces just its own rounds, so a failed run can be repeated.
    """
    spark = rows.sparkSession
    completed = rounds.completed_rounds(rows, as_of).select("round")
    finished = store.finished_rounds(store.stored_inventory(spark, root)) if skip_existing else None
    chosen = store.rounds_to_process(
        completed, start_round=start_round, end_round=end_round, skip_rounds=skip_rounds, step=step, finished=finished
    )
    wanted = sorted(r["round"] for r in chosen.collect())  # at most one number per round
    if not wanted:
        return []
    # all cut-offs up to the last one wanted, so that stored strength paths do not depend on what this call writes
    rows = settle(rows)
    draws = settle(strength_table(rows, range(1, wanted[-1]), config, group))
    store.write_round_table(predict_rounds(rows, wanted, draws, config), root, "predictions")
    store.write_round_table(rounds.round_actuals(played(rows).where(F.col("round").isin(wanted))), root, "actuals")
    store.write_round_table(_strengths_by_round(draws, wanted), root, "team_strengths")
    return wanted


def _strengths_by_round(draws: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Per stored round and team: the path of strengths up to its cut-off, in the nested store shape.

    Summaries are one row per (param, team, cut-off); only those are copied to later rounds.
    """
    params = F.array(*[F.struct(F.lit(p).alias("param"), F.col("t"), F.col(p).alias("value")) for p in ("attack", "defence", "home_adv")])
    summary = D.summarise(draws.select("team_id", F.inline(params)), ["param", "team_id", "t"])
    rounds_after = F.filter(F.array(*[F.lit(int(r)) for r in wanted]), lambda r: r - 1 >= F.col("t"))
    spread = summary.withColumn("round", F.explode(rounds_after))
    latest = (F.col("param") != "home_adv") | (F.col("t") == F.col("round") - 1)
    return D.nest_strengths(spread.where(latest), ("round", "team_id"))
