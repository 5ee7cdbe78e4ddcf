"""Attack, defence and home strengths for many groups at once, by penalised Poisson point estimates.

Expected goals are level x attack[team] x concession[opponent] x home (home rows only), i.e. log-linear
with `attack = ln att`, `defence = -ln dfn`. A group (league, season, cut-off round, replicate, decay,
...) is just part of the key, so one job fits every group. Matches enter only through sums per
(group, team, opponent, home), so a step costs the same however many matches there were.

These estimate the same quantities as a Bayesian fit of the model; they are not its posterior.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.functions import scalars as S
from touchline.operators.cells import largest_group
from touchline.session import broadcast_within, settle, small_side


def suffstats(
    rows: DataFrame, group: Sequence[str] = (), weight: Column | None = None, goals: str = "goals"
) -> DataFrame:
    """Weighted goals and weight per (group, team, opp_team, is_home), combined map-side."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return rows.groupBy(*group, "team", "opp_team", "is_home").agg(
        F.sum(w).alias("weight"), F.sum(w * F.col(goals)).alias("goals")
    )


def initial_state(stats: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per (group, team): goals for and against, neutral strengths, group totals."""
    keys = [*group, "team"]
    entries = F.array(
        F.struct(F.col("team").alias("who"), F.col("goals").alias("scored"), F.lit(0.0).alias("conceded"), "goals", "weight", "is_home"),
        F.struct(F.col("opp_team").alias("who"), F.lit(0.0).alias("scored"), F.col("goals").alias("conceded"),
                 F.lit(0.0).alias("goals"), F.lit(0.0).alias("weight"), "is_home"),
    )
    home = F.col("is_home") == 1
    per_team = (
        stats.select(*group, F.inline(entries))
        .groupBy(*group, F.col("who").alias("team"))
        .agg(
            F.sum("scored").alias("scored"),
            F.sum("conceded").alias("conceded"),
            F.sum(F.when(home, F.col("goals")).otherwise(0.0)).alias("_gh"),
            F.sum(F.when(home, F.lit(0.0)).otherwise(F.col("goals"))).alias("_ga"),
            F.sum("weight").alias("_w"),
        )
    )
    # From here on a group is one row per team; windows over it no longer depend on match counts.
    over = Window.partitionBy(*group)
    return per_team.select(
        *keys, "scored", "conceded",
        F.sum("_gh").over(over).alias("goals_home_total"),
        F.sum("_ga").over(over).alias("goals_away_total"),
        F.lit(1.0).alias("att"), F.lit(1.0).alias("dfn"),
        ((F.sum("_gh").over(over) + F.sum("_ga").over(over)) / F.sum("_w").over(over)).alias("mu"),
        F.lit(1.0).alias("home"), F.lit(None).cast("double").alias("change"),
    )


def fit_step(stats: DataFrame, state: DataFrame, group: Sequence[str], prior: float, small: bool) -> DataFrame:
    """One sweep: attacks given the rest, then concessions, then centre both and refit level and home."""
    keys = [*group, "team"]
    hint = F.broadcast if small else (lambda df: df)
    p = F.lit(float(prior))
    host = F.col("is_home") == 1
    known = state.drop("change", "sweeps")

    def exposure(strength: str, home_name: str, away_name: str) -> list[Column]:
        load = F.col("weight") * F.col(strength)
        return [
            F.sum(F.when(host, load).otherwise(0.0)).alias(home_name),
            F.sum(F.when(host, F.lit(0.0)).otherwise(load)).alias(away_name),
        ]

    def filled(home_name: str, away_name: str) -> Column:
        return F.col("home") * F.coalesce(home_name, F.lit(0.0)) + F.coalesce(away_name, F.lit(0.0))

    opponents = known.select(*group, F.col("team").alias("opp_team"), "dfn")
    faced = stats.join(hint(opponents), [*group, "opp_team"]).groupBy(*keys).agg(*exposure("dfn", "_ah", "_aa"))
    attack = known.join(faced, keys, "left").withColumn(
        "_att", (p + F.col("scored")) / (p + F.col("mu") * filled("_ah", "_aa"))
    )
    allowed = (
        stats.join(hint(attack.select(*keys, "_att")), keys)
        .groupBy(*group, F.col("opp_team").alias("team"))
        .agg(*exposure("_att", "_dh", "_da"))
    )
    both = attack.join(allowed, keys, "left").withColumn(
        "_dfn", (p + F.col("conceded")) / (p + F.col("mu") * filled("_dh", "_da"))
    )
    over = Window.partitionBy(*group)
    both = both.withColumns(
        {
            "_la": F.avg(F.log("_att")).over(over),
            "_ld": F.avg(F.log("_dfn")).over(over),
            "_eh": F.sum(F.col("_dfn") * F.coalesce("_dh", F.lit(0.0))).over(over),
            "_ea": F.sum(F.col("_dfn") * F.coalesce("_da", F.lit(0.0))).over(over),
        }
    )
    # Given the strengths, away goals fix the level and home goals the home factor.
    raw_mu = F.coalesce(F.try_divide("goals_away_total", "_ea"), F.col("mu"))
    both = both.withColumn("_mu", F.when(raw_mu > 0, raw_mu).otherwise(F.col("mu")))
    raw_home = F.coalesce(F.try_divide(F.col("goals_home_total"), F.col("_mu") * F.col("_eh")), F.col("home"))
    att, dfn = F.col("_att") / F.exp("_la"), F.col("_dfn") / F.exp("_ld")
    return both.select(
        *keys, "scored", "conceded", "goals_home_total", "goals_away_total",
        att.alias("att"), dfn.alias("dfn"),
        (F.col("_mu") * F.exp(F.col("_la") + F.col("_ld"))).alias("mu"),
        F.when(raw_home > 0, raw_home).otherwise(F.col("home")).alias("home"),
        F.greatest(F.abs(F.log(att / F.col("att"))), F.abs(F.log(dfn / F.col("dfn")))).alias("change"),
    )


#: Most rows of sums of a group that one task fits by itself.
LOCAL_ROWS = 500_000


def _sweep(x: dict, prior: float) -> float:
    """The sweep of `fit_step` on one group's arrays, in place; returns the largest change."""
    teams, team, opp = len(x["att"]), x["team"], x["opp"]

    def exposure(at: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(at, load * x["host"], teams), np.bincount(at, load * ~x["host"], teams)

    home, away = exposure(team, x["weight"] * x["dfn"][opp])
    att = (prior + x["scored"]) / (prior + x["mu"] * (x["home"] * home + away))
    home, away = exposure(opp, x["weight"] * att[team])
    dfn = (prior + x["conceded"]) / (prior + x["mu"] * (x["home"] * home + away))
    la, ld, eh, ea = np.log(att).mean(), np.log(dfn).mean(), (dfn * home).sum(), (dfn * away).sum()
    mu = x["goals_away"] / ea if ea and x["goals_away"] > 0 else x["mu"]
    factor = x["goals_home"] / (mu * eh) if mu * eh and x["goals_home"] > 0 else x["home"]
    att, dfn = att / np.exp(la), dfn / np.exp(ld)
    change = max(np.abs(np.log(att / x["att"])).max(), np.abs(np.log(dfn / x["dfn"])).max())
    x.update(att=att, dfn=dfn, mu=mu * np.exp(la + ld), home=factor)
    return float(change)


def _fit_groups(stats: DataFrame, state: DataFrame, group: Sequence[str], prior: float, steps: int, tolerance: float) -> DataFrame:
    """Every group fitted by one task: its sums and its first state are small tables."""
    import pandas as pd

    out = StructType([*state.schema.fields, *StructType.fromDDL("sweeps int").fields])
    names = out.names

    def fit(sums: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if start.empty:
            return pd.DataFrame({n: [] for n in names})
        number = pd.Index(start["team"])
        known = sums[sums["team"].isin(number) & sums["opp_team"].isin(number)]
        x = {
            "team": number.get_indexer(known["team"]), "opp": number.get_indexer(known["opp_team"]), "host": known["is_home"].to_numpy() == 1,
            "weight": known["weight"].to_numpy(float), "scored": start["scored"].to_numpy(float), "conceded": start["conceded"].to_numpy(float),
            "att": start["att"].to_numpy(float), "dfn": start["dfn"].to_numpy(float), "mu": float(start["mu"].iloc[0]), "home": float(start["home"].iloc[0]),
            "goals_home": float(start["goals_home_total"].iloc[0]), "goals_away": float(start["goals_away_total"].iloc[0]),
        }
        change, sweeps = np.inf, 0
        while sweeps < steps and change >= tolerance:
            change, sweeps = _sweep(x, prior), sweeps + 1
        return start.assign(att=x["att"], dfn=x["dfn"], mu=x["mu"], home=x["home"], change=change, sweeps=sweeps)[names]

    keys = list(group) or [F.lit("all")]
    return stats.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(fit, out)


def fit_state(
    stats: DataFrame, group: Sequence[str] = (), *, prior: float = 5.0, steps: int = 200, tolerance: float = 1e-10,
    local_rows: int = LOCAL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Settled sums and fitted state. Each group sweeps until its largest change is below `tolerance`; `steps` bound the sweeps.

    A `tolerance` of 0 makes exactly `steps` sweeps. `change` and `sweeps` of the state tell how a group's fit ended; if any
    did not converge there is a warning.

    If no group has more than `local_rows` rows of sums, each is fitted by one task, so a fit is one shuffle however many sweeps it takes.
    Otherwise a sweep is two joins and two aggregations over all groups that still move: groups that have converged leave as
    soon as they are half of those left. Each sweep is cut off through the reliable checkpoint folder: plans stay one
    sweep deep and a lost executor repeats at most one sweep.
    """
    stats = settle(stats)
    state = settle(initial_state(stats, group))
    if largest_group(stats, list(group)) <= local_rows:
        state = settle(_fit_groups(stats, state, group, prior, steps, tolerance))
        largest = state.agg(F.max("change")).first()[0]
        if tolerance > 0 and largest is not None and largest >= tolerance:
            warnings.warn(f"strengths still change by {largest:.2g} after {steps} sweeps", stacklevel=2)
        return stats, state
    small = broadcast_within(state) is not state
    moving, done, largest = stats, [], None
    for sweep in range(1, steps + 1):
        state = settle(fit_step(moving, state, group, prior, small)).withColumn("sweeps", F.lit(sweep))
        if tolerance <= 0:
            continue
        if not group:
            largest = state.agg(F.max("change")).first()[0]
            if largest is None or largest < tolerance:
                break
            continue
        ends = settle(state.groupBy(*group).agg(F.max("change").alias("_largest")))
        n, still, largest = ends.agg(F.count(F.lit(1)), F.count_if(F.col("_largest") >= tolerance), F.max("_largest")).first()
        if not still:
            break
        if 2 * still <= n:
            active = broadcast_within(ends.where(F.col("_largest") >= tolerance).select(*group))
            done.append(state.join(active, list(group), "left_anti"))
            state, moving = settle(state.join(active, list(group), "left_semi")), settle(moving.join(active, list(group), "left_semi"))
    else:
        if tolerance > 0:
            warnings.warn(f"strengths still change by {largest:.2g} after {steps} sweeps", stacklevel=2)
    for part in done:
        state = state.unionByName(part)
    return stats, state


def convergence(state: DataFrame, group: Sequence[str] = (), tolerance: float = 1e-10) -> DataFrame:
    """Sweeps, last change and whether it is below `tolerance`, per group of a fitted state."""
    return state.groupBy(*group).agg(
        F.max("sweeps").alias("sweeps"), F.max("change").alias("change"), (F.max("change") < tolerance).alias("converged")
    )


def fit_strengths(
    stats: DataFrame, group: Sequence[str] = (), *, prior: float = 5.0, steps: int = 200, tolerance: float = 1e-10
) -> DataFrame:
    """`attack`, `defence` (large = strong), `level` and `home`, all on the log scale, per (group, team)."""
    _, state = fit_state(stats, group, prior=prior, steps=steps, tolerance=tolerance)
    return log_scale(state, group)


def log_scale(state: DataFrame, group: Sequence[str]) -> DataFrame:
    return state.select(
        *group, "team", F.log("att").alias("attack"), (-F.log("dfn")).alias("defence"),
        F.log("mu").alias("level"), F.log("home").alias("home"),
    )


def home_advantage(
    stats: DataFrame, group: Sequence[str] = (), *, prior: float = 5.0, pool: float = 20.0, steps: int = 200,
    tolerance: float = 1e-10,
) -> DataFrame:
    """Per-team home advantage (log scale), pooled towards the group's with `pool` goals of weight."""
    stats, state = fit_state(stats, group, prior=prior, steps=steps, tolerance=tolerance)
    keys = [*group, "team"]
    dfn = broadcast_within(state.select(*group, F.col("team").alias("opp_team"), F.col("dfn").alias("_dfn")))
    hosted = (
        stats.where(F.col("is_home") == 1)
        .join(dfn, [*group, "opp_team"])
        .groupBy(*keys)
        .agg(F.sum("goals").alias("_g"), F.sum(F.col("weight") * F.col("_dfn")).alias("_e"))
    )
    own = state.join(hosted, keys, "left")
    expected = F.coalesce(F.col("mu") * F.col("att") * F.col("_e"), F.lit(0.0))
    rate = (F.lit(float(pool)) * F.col("home") + F.coalesce("_g", F.lit(0.0))) / (F.lit(float(pool)) + expected)
    return own.select(
        *keys, F.log("att").alias("attack"), (-F.log("dfn")).alias("defence"), F.log("mu").alias("level"),
        F.log("home").alias("home"), F.log(rate).alias("home_adv"),
    )


def stats_until(
    rows: DataFrame, cutoffs: Sequence[int], *, decays: Mapping[str, float] | None = None, group: Sequence[str] = (),
    t: str = "cum_round", goals: str = "goals", weight: Column | None = None,
) -> DataFrame:
    """Sums for every cut-off T over rounds t <= T with weight decay^(T - t), times a row `weight` if given.

    Rows are first summed per (team, opponent, home, round). The sum at a round is the one before it,
    faded, plus the round's own, so one running sum per pair of teams gives all cut-offs; a pair's sum is then
    spelled out for the cut-offs up to its next round. The cost is that of the output: pairs times cut-offs.
    `cutoffs` are rounds, so the list is bounded by the calendar. With several `decays` their names
    become part of the group key. Decays so strong that the first round's weight at the last cut-off is below
    e^-600 are refused, since the running sum is kept relative to a pair's first round.
    """
    cuts = sorted({int(c) for c in cutoffs})
    decays = decays or {"all": 1.0}
    if cuts and any(d <= 0 or -math.log(d) * (cuts[-1] - min(cuts[0], 0)) > 600 for d in decays.values()):
        raise ValueError("decay too strong for this many rounds")
    if not cuts:
        cuts = [-1]
    own = F.lit(1) if weight is None else weight
    pair = [*group, "team", "opp_team", "is_home"]
    rate = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(d)).alias("value")) for n, d in decays.items()]))
    by_round = (
        rows.where(F.col(t) <= cuts[-1])
        .groupBy(*pair, F.col(t).alias("_t"))
        .agg(F.sum(own).alias("_n"), F.sum(own * F.col(goals)).alias("_g"))
    )
    whole = Window.partitionBy(*pair)
    scan = whole.orderBy("_t")
    since = (F.col("_t") - F.col("_start")).cast("double")
    upto = Window.partitionBy(*pair, "_decay.name").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.pow(F.col("_decay.value"), -since)
    summed = (
        by_round.withColumns({"_start": F.min("_t").over(whole), "_until": F.coalesce(F.lead("_t").over(scan) - 1, F.lit(cuts[-1]))})
        .withColumn("_decay", rate)
        .withColumns({"_w": F.sum(grown * F.col("_n")).over(upto), "_wg": F.sum(grown * F.col("_g")).over(upto)})
    )
    first = F.greatest(F.col("_t"), F.lit(cuts[0]))
    spread = summed.where(first <= F.col("_until")).withColumn("cutoff", F.explode(F.sequence(first.cast("int"), F.col("_until").cast("int"))))
    if cuts != list(range(cuts[0], cuts[-1] + 1)):
        spread = spread.where(F.col("cutoff").isin(cuts))
    fade = F.pow(F.col("_decay.value"), (F.col("cutoff") - F.col("_start")).cast("double"))
    return spread.select(
        *group, "cutoff", F.col("_decay.name").alias("decay"), "team", "opp_team", "is_home",
        (fade * F.col("_w")).alias("weight"), (fade * F.col("_wg")).alias("goals"),
    )


def strengths_by_round(
    rows: DataFrame, cutoffs: Sequence[int], *, decay: float = 29.0 / 30.0, group: Sequence[str] = (), prior: float = 5.0,
    steps: int = 200, tolerance: float = 1e-10,
) -> DataFrame:
    """Time-varying strengths: one fit per cut-off round, older rounds fading."""
    stats = stats_until(rows, cutoffs, decays={"all": decay}, group=group).drop("decay")
    return fit_strengths(stats, [*group, "cutoff"], prior=prior, steps=steps, tolerance=tolerance)


def ability_form(
    rows: DataFrame, cutoffs: Sequence[int], *, slow: float = 49.0 / 50.0, fast: float = 8.0 / 9.0, group: Sequence[str] = (),
    prior: float = 5.0, steps: int = 200, tolerance: float = 1e-10,
) -> DataFrame:
    """Slow-decay strength as ability and the fast fit's difference from it as form; both in one job."""
    stats = stats_until(rows, cutoffs, decays={"ability": slow, "fast": fast}, group=group)
    fit = fit_strengths(stats, [*group, "cutoff", "decay"], prior=prior, steps=steps, tolerance=tolerance)

    def of(decay: str, c: str) -> Column:
        return F.max(F.when(F.col("decay") == decay, F.col(c)))

    return fit.groupBy(*group, "cutoff", "team").agg(
        of("ability", "attack").alias("attack_ability"),
        (of("fast", "attack") - of("ability", "attack")).alias("attack_form"),
        of("ability", "defence").alias("defence_ability"),
        (of("fast", "defence") - of("ability", "defence")).alias("defence_form"),
    )


def bootstrap_stats(rows: DataFrame, key: str, replicates: int, *, seed: int = 42, group: Sequence[str] = ()) -> DataFrame:
    """Sums per replicate with Poisson(1) match weights drawn from (match, replicate) by hashing.

    Both rows of a match get the same weight on any partitioning. Rows fan out only inside a task and
    are summed before the shuffle. Matches of weight 0 stay, so that every replicate has every team.
    """
    fanned = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(int(replicates)))))
    weight = S.poisson_one(S.mixed_uniform(seed, F.col(key), F.col("replicate")))
    drawn = fanned.withColumn("_weight", weight)
    return suffstats(drawn, [*group, "replicate"], F.col("_weight"))


def bootstrap_draws(
    rows: DataFrame, key: str, replicates: int, *, seed: int = 42, group: Sequence[str] = (), prior: float = 5.0,
    pool: float = 20.0, steps: int = 200, tolerance: float = 1e-10, t: int = 0,
) -> DataFrame:
    """Draws table from replicate fits. A match bootstrap shows sampling spread; it is not a posterior.

    The group's level is added to attack, so `attack - defence (+ home_adv)` is a log rate.
    """
    stats = bootstrap_stats(rows, key, replicates, seed=seed, group=group)
    fit = home_advantage(stats, [*group, "replicate"], prior=prior, pool=pool, steps=steps, tolerance=tolerance)
    return fit.select(
        *group, F.lit(0).alias("chain"), F.col("replicate").alias("draw"), F.lit(t).alias("t"), F.col("team").alias("team_id"),
        (F.col("attack") + F.col("level")).alias("attack"), "defence", "home_adv",
    )


def _newton(pairs, group: Sequence[str], prior: float):
    """One Newton step of a group from its sums per pair of teams: rows of (kind, team, value, se, step)."""
    import pandas as pd

    team, opp = (pd.Index(pairs[c].unique()) for c in ("team", "opp_team"))
    t, o = team.get_indexer(pairs["team"]), opp.get_indexer(pairs["opp_team"])
    n_t, n_o = len(team), len(opp)
    col = {c: pairs[c].to_numpy(float) for c in ("l", "lx", "lxx", "lh", "lxh", "y", "yx", "yh", "a", "c")}
    a, c = np.zeros(n_t), np.zeros(n_o)
    a[t], c[o] = col["a"], col["c"]
    head = np.array([float(pairs[k].iloc[0]) for k in ("m", "h", "b")])
    by = lambda at, n, values: np.bincount(at, values, n)
    total = {k: v.sum() for k, v in col.items()}

    # second derivatives, all with their sign turned: head and teams, opponents, and between them
    upper = np.zeros((3 + n_t, 3 + n_t))
    upper[:3, :3] = [[total["l"], total["lh"], total["lx"]], [total["lh"], total["lh"], total["lxh"]], [total["lx"], total["lxh"], total["lxx"]]]
    upper[:3, 3:] = [by(t, n_t, col[k]) for k in ("l", "lh", "lx")]
    upper[3:, :3] = upper[:3, 3:].T
    upper[np.arange(3, 3 + n_t), np.arange(3, 3 + n_t)] = by(t, n_t, col["l"]) + prior * np.exp(a)
    between = np.zeros((3 + n_t, n_o))
    between[:3] = [by(o, n_o, col[k]) for k in ("l", "lh", "lx")]
    np.add.at(between, (3 + t, o), col["l"])
    lower = by(o, n_o, col["l"]) + prior * np.exp(c)
    slope = np.r_[total["y"] - total["l"], total["yh"] - total["lh"], total["yx"] - total["lx"], by(t, n_t, col["y"] - col["l"]) + prior * (1 - np.exp(a))]
    slope_c = by(o, n_o, col["y"] - col["l"]) + prior * (1 - np.exp(c))

    # opponents' block is diagonal: eliminate it, solve for the rest, put it back
    schur = upper - between / lower @ between.T
    step = np.linalg.solve(schur, slope - between @ (slope_c / lower))
    step_c = (slope_c - between.T @ step) / lower
    spread = np.sqrt(np.diag(np.linalg.inv(schur)))
    largest = max(np.abs(step).max(), np.abs(step_c).max())
    scale = min(1.0, 1.0 / largest) if largest > 0 else 1.0
    out = pd.DataFrame({
        "kind": ["m", "h", "b"] + ["a"] * n_t + ["c"] * n_o, "team": [None] * 3 + list(team) + list(opp),
        "value": np.r_[head + scale * step[:3], a + scale * step[3:], c + scale * step_c],
        "se": np.r_[spread, np.full(n_o, np.nan)], "step": np.full(3 + n_t + n_o, largest),
    })
    for k in group:
        out[k] = pairs[k].iloc[0]
    return out[[*group, "kind", "team", "value", "se", "step"]]


def slope_effects(
    rows: DataFrame, x: Column, group: Sequence[str] = (), *, goals: str = "goals", prior: float = 5.0, steps: int = 50, tolerance: float = 1e-9
) -> DataFrame:
    """Poisson fit of goals on `x` with level, home, team and opponent effects, per group, by Newton steps.

    Rows of (group, kind, team, value, se, step): kinds are m (level), h (home), b (slope of `x`), a (a team's attack) and c (what an
    opponent concedes), all on the log scale; team and opponent effects are drawn to 0 with a weight of `prior` goals.
    Derivatives are sums over rows per pair of teams, combined map-side. A group's pairs of teams go to one task, which eliminates the opponents
    from the second derivatives, solves for the rest, and reads standard errors off the same matrix. Groups take their steps together; `step` is
    the last one's largest change. Rows without team, opponent, goals or `x` count for nothing.
    """
    group = list(group)
    base = rows.select(
        *group, "team", "opp_team", (F.col("is_home") == 1).cast("double").alias("_home"), F.col(goals).cast("double").alias("_y"), x.cast("double").alias("_x")
    )
    known = F.lit(True)
    for c in ("team", "opp_team", "_home", "_y", "_x"):
        known = known & F.col(c).isNotNull()
    base = settle(base.where(known))
    pairs = base.select(*group, "team", "opp_team").distinct()
    if largest_group(pairs, group) > LOCAL_ROWS:
        raise ValueError("a group has too many pairs of teams for one task")
    schema = StructType([*[base.schema[k] for k in group], *StructType.fromDDL("kind string").fields, base.schema["team"], *StructType.fromDDL("value double, se double, step double").fields])
    level = F.when(F.avg("_y") > 0, F.log(F.when(F.avg("_y") > 0, F.avg("_y")))).otherwise(0.0)
    heads = base.groupBy(*group).agg(level.alias("m")).withColumns({"h": F.lit(0.0), "b": F.lit(0.0)})
    effects = None
    for _ in range(steps):
        met = base.join(F.broadcast(heads), group) if group else base.crossJoin(F.broadcast(heads))  # a row per group
        if effects is None:
            met = met.withColumns({"a": F.lit(0.0), "c": F.lit(0.0)})
        else:
            of = lambda kind, name, key: broadcast_within(effects.where(F.col("kind") == kind).select(*group, F.col("team").alias(key), F.col("value").alias(name)))
            met = met.join(of("a", "a", "team"), [*group, "team"]).join(of("c", "c", "opp_team"), [*group, "opp_team"])
        rate = F.exp(F.col("m") + F.col("a") + F.col("c") + F.col("h") * F.col("_home") + F.col("b") * F.col("_x"))
        sums = {
            "l": F.col("_l"), "lx": F.col("_l") * F.col("_x"), "lxx": F.col("_l") * F.col("_x") * F.col("_x"), "lh": F.col("_l") * F.col("_home"),
            "lxh": F.col("_l") * F.col("_x") * F.col("_home"), "y": F.col("_y"), "yx": F.col("_y") * F.col("_x"), "yh": F.col("_y") * F.col("_home"),
        }
        by_pair = met.withColumn("_l", rate).groupBy(*group, "team", "opp_team").agg(
            *[F.sum(v).alias(k) for k, v in sums.items()], *[F.first(k).alias(k) for k in ("a", "c", "m", "h", "b")]
        )
        effects = settle(by_pair.groupBy(*(group or [F.lit("all")])).applyInPandas(lambda pdf: _newton(pdf, group, prior), schema))
        pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(kind)
        heads = effects.groupBy(*group).agg(pick("m"), pick("h"), pick("b"))
        largest = effects.agg(F.max("step")).first()[0]
        if largest is None or largest < tolerance:
            return effects
    warnings.warn(f"effects still change by {largest:.2g} after {steps} steps", stacklevel=2)
    return effects


def xg_weight(
    rows: DataFrame, *, xg: str = "xG", group: Sequence[str] = (), strengths: DataFrame | None = None, adjustment: float = 0.3, prior: float = 5.0
) -> DataFrame:
    """Weight of log expected goals in a Poisson regression with team, opponent and home effects, per group, with standard errors.

    With `strengths` (team, defence) the xG term is scaled by the opponent factor first; opponents without strengths get the mean
    defence. Rows of (group, parameter, estimate, standard_error): the xG weight, home advantage and intercept.
    """
    x = S.log_xg(F.col(xg))
    if strengths is not None:
        opp = small_side(strengths.select(F.col("team").alias("opp_team"), F.col("defence").alias("_d")))
        mean = opp.agg(F.avg("_d").alias("_m"))  # one row
        rows = rows.join(opp, "opp_team", "left").crossJoin(F.broadcast(mean))
        x = x * S.hard_clip(1 + F.lit(adjustment) * F.coalesce("_d", "_m"), *S.OPPONENT_FACTOR_BOUNDS)
    names = F.create_map(F.lit("b"), F.lit("xg_weight"), F.lit("h"), F.lit("home"), F.lit("m"), F.lit("intercept"))
    effects = slope_effects(rows, x, group, prior=prior).where(F.col("kind").isin("b", "h", "m"))
    return effects.select(*group, names[F.col("kind")].alias("parameter"), F.col("value").alias("estimate"), F.col("se").alias("standard_error"))
