"""Strength fits, predictions, evaluation and diagnostics on planted data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import diagnostics as G
from touchline.operators import draws as D
from touchline.operators import evaluate as E
from touchline.operators import predict as P
from touchline.operators import strength


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    teams = [f"T{i:02d}" for i in range(12)]
    att, dfn = rng.normal(0, 0.35, 12), rng.normal(0, 0.35, 12)
    att, dfn = att - att.mean(), dfn - dfn.mean()
    rows, no = [], 0
    for r in range(1, 45):
        order = rng.permutation(12)
        for h, a in zip(order[:6], order[6:]):
            gh, ga = rng.poisson(math.exp(0.2 + att[h] - dfn[a] + 0.3)), rng.poisson(math.exp(0.2 + att[a] - dfn[h]))
            rows += [(no, r, teams[h], teams[a], 1, int(gh), int(ga)), (no, r, teams[a], teams[h], 0, int(ga), int(gh))]
            no += 1
    return teams, att, dfn, rows


@pytest.fixture(scope="module")
def rows(spark, planted):
    schema = "match_id long, round int, team string, opp_team string, is_home int, goals int, goals_against int"
    return spark.createDataFrame(planted[3], schema).withColumn("cum_round", F.col("round")).cache()


def test_fit_recovers_planted_strengths(rows, planted):
    teams, att, dfn, _ = planted
    fit = strength.fit_strengths(strength.suffstats(rows), prior=2.0).toPandas().set_index("team").loc[teams]
    assert np.corrcoef(fit.attack, att)[0, 1] > 0.93 and np.corrcoef(fit.defence, dfn)[0, 1] > 0.93
    assert abs(fit.attack.mean()) < 1e-9 and abs(fit.defence.mean()) < 1e-9
    assert abs(fit.home.iloc[0] - 0.3) < 0.15


def test_fit_is_at_a_fixed_point(rows):
    fit = strength.fit_strengths(strength.suffstats(rows), prior=2.0, steps=40, tolerance=1e-9).toPandas().set_index("team")
    data = rows.toPandas()
    f = lambda c, who: fit[c].loc[data[who]].to_numpy()
    rate = np.exp(fit.level.iloc[0] + f("attack", "team") - f("defence", "opp_team") + fit.home.iloc[0] * data.is_home)
    by_venue = pd.DataFrame({"h": data.is_home, "g": data.goals, "e": rate}).groupby("h").sum()
    assert np.allclose(by_venue.g, by_venue.e, rtol=1e-6)


def test_groups_are_independent_and_broadcast_does_not_matter(spark, rows, monkeypatch):
    doubled = rows.withColumn("g", F.explode(F.array(F.lit(1), F.lit(2))))
    stats = strength.suffstats(doubled, ["g"])
    a = strength.fit_strengths(stats, ["g"], steps=3, tolerance=0).toPandas().sort_values(["g", "team"])
    one = strength.fit_strengths(strength.suffstats(rows), steps=3, tolerance=0).toPandas().sort_values("team")
    assert np.allclose(a[a.g == 1].attack, one.attack) and np.allclose(a[a.g == 2].attack, one.attack)
    monkeypatch.setattr(strength, "broadcast_within", lambda df, *_: df)
    b = strength.fit_strengths(stats, ["g"], steps=3, tolerance=0).toPandas().sort_values(["g", "team"])
    assert np.allclose(a.attack, b.attack)


def test_cutoff_sums_equal_direct_sums(rows):
    got = strength.stats_until(rows, [10, 25], decays={"d": 0.9}).toPandas()
    data = rows.toPandas()
    for cut in (10, 25):
        part = data[data["round"] <= cut]
        w = 0.9 ** (cut - part["round"])
        assert np.isclose(got[got.cutoff == cut].weight.sum(), w.sum())
        assert np.isclose(got[got.cutoff == cut].goals.sum(), (w * part.goals).sum())


def test_bootstrap_weights_are_shared_by_both_sides(rows):
    stats = strength.bootstrap_stats(rows, "match_id", 30).groupBy("replicate", "is_home").agg(F.sum("weight").alias("w")).toPandas()
    wide = stats.pivot(index="replicate", columns="is_home", values="w")
    assert (wide[0] == wide[1]).all()
    assert abs(wide[0].mean() - 264) < 15 and wide[0].std() > 5


def test_xg_weight_finds_the_planted_slope(spark):
    rng = np.random.default_rng(1)
    data = [("AB"[i % 2], "BA"[i % 2], i % 2, float(x), int(rng.poisson(1.2 * x**0.8))) for i, x in enumerate(rng.random(4000) * 3 + 0.1)]
    df = spark.createDataFrame(data, "team string, opp_team string, is_home int, xG double, goals int")
    got = {r["parameter"]: r["estimate"] for r in strength.xg_weight(df).collect()}
    assert abs(got["xg_weight"] - 0.8) < 0.08


def test_slope_effects_are_the_optimum_with_standard_errors(spark):
    """Two groups against a dense Newton fit in numpy; the standard error comes from its whole second-derivative matrix."""
    rng = np.random.default_rng(2)
    teams, rows = list("ABCDEF"), []
    for g, slope in (("x", 0.7), ("y", -0.4)):
        for k in range(900):
            t, o = rng.choice(6, 2, replace=False)
            x = float(rng.normal())
            rows.append((g, teams[t], teams[o], k % 2, x, int(rng.poisson(np.exp(0.1 * t - 0.05 * o + 0.2 * (k % 2) + slope * x)))))
    rows += [("x", None, "A", 1, 0.0, 9), ("x", "A", "B", 1, None, 9), ("y", "A", None, 0, 0.0, 9)]
    df = spark.createDataFrame(rows, "g string, team string, opp_team string, is_home int, x double, goals int")
    got = {(r["g"], r["kind"], r["team"]): (r["value"], r["se"]) for r in strength.slope_effects(df, F.col("x"), ["g"], prior=4.0).collect()}
    for g in "xy":
        known = [r for r in rows if r[0] == g and r[1] and r[2] and r[4] is not None]
        design = np.zeros((len(known), 15))
        for k, (_, t, o, home, x, _) in enumerate(known):
            design[k, [0, 3 + teams.index(t), 9 + teams.index(o)]] = 1
            design[k, 1:3] = home, x
        y, theta, prior = np.array([r[5] for r in known]), np.zeros(15), np.r_[np.zeros(3), np.full(12, 4.0)]
        for _ in range(60):
            rate = np.exp(design @ theta)
            slope = design.T @ (y - rate) + prior * (1 - np.exp(theta))
            second = design.T @ (design * rate[:, None]) + np.diag(prior * np.exp(theta))
            step = np.linalg.solve(second, slope)
            theta += step * min(1, 1 / np.abs(step).max())
        errors = np.sqrt(np.diag(np.linalg.inv(second)))
        for k, kind in enumerate("mhb"):
            assert got[g, kind, None] == pytest.approx((theta[k], errors[k]), abs=1e-7)
        assert [got[g, "a", t][0] for t in teams] == pytest.approx(theta[3:9], abs=1e-7)
        assert [got[g, "c", t][0] for t in teams] == pytest.approx(theta[9:], abs=1e-7)


def test_unseen_opponents_keep_their_rows(spark):
    data = [("AB"[i % 2], "BA"[i % 2], i % 2, 0.5 + i % 7 / 4, 1 + i % 3) for i in range(400)] + [("A", "C", 1, 1.0, 2)] * 50
    df = spark.createDataFrame(data, "team string, opp_team string, is_home int, xG double, goals int")
    known = spark.createDataFrame([("A", 0.2), ("B", -0.2)], "team string, defence double")
    got = {r["parameter"]: r for r in strength.xg_weight(df, strengths=known).collect()}
    without = {r["parameter"]: r for r in strength.xg_weight(df.where("opp_team <> 'C'"), strengths=known).collect()}
    assert got["home"]["estimate"] != without["home"]["estimate"] and all(r["standard_error"] > 0 for r in got.values())


@pytest.mark.parametrize("group", [[], ["g"]])
def test_local_and_distributed_fits_agree(spark, group):
    """Groups that converge at different speeds; the distributed form lets those that are done leave."""
    rng = np.random.default_rng(5)
    rows = [(g, "ABCDEFGH"[t], "ABCDEFGH"[o], k % 2, int(rng.poisson(1.3 + t / 8))) for g in range(6) for k in range(40 * (1 + g)) for t, o in [rng.choice(8, 2, replace=False)]]
    stats = strength.suffstats(spark.createDataFrame(rows, "g int, team string, opp_team string, is_home int, goals int"), group)
    _, near = strength.fit_state(stats, group, tolerance=1e-9)
    _, far = strength.fit_state(stats, group, tolerance=1e-9, local_rows=0)
    columns = [*group, "team", "att", "dfn", "mu", "home"]
    near, far = ({tuple(r[: len(group) + 1]): r[len(group) + 1 :] for r in map(tuple, s.select(*columns).collect())} for s in (near, far))
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k], abs=1e-7) for k in near)
    _, again = strength.fit_state(stats, group, tolerance=1e-9, local_rows=0)
    ends = strength.convergence(again, group, 1e-9).collect()
    assert len(ends) == (6 if group else 1) and all(r["converged"] and 3 < r["sweeps"] < 100 for r in ends)
    with pytest.warns(UserWarning, match="still change"):
        strength.fit_state(stats, group, steps=2)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(9)
    d = [(c, n, t, k, float(rng.normal(0, .3)), float(rng.normal(0, .3)), 0.25) for c in range(2) for n in range(50) for t in range(3) for k in range(4)]
    draws = spark.createDataFrame(d, "chain int, draw int, t int, team_id int, attack double, defence double, home_adv double")
    fixtures = spark.createDataFrame([(1, 2, 0, 1), (2, 9, 2, 3)], "match_id long, round int, home_id int, away_id int")
    return draws, fixtures, d


def test_rates_use_the_round_before_or_the_last_step(small):
    draws, fixtures, d = small
    got = P.goal_rates(fixtures, draws).toPandas().sort_values(["match_id", "chain", "draw"])
    assert len(got) == 200
    by = {(c, n, t, k): (a, b) for c, n, t, k, a, b, _ in d}
    for m, t, h, a in ((1, 1, 0, 1), (2, 2, 2, 3)):
        r = got[got.match_id == m].iloc[7]
        att, _ = by[(r.chain, r.draw, t, h)]
        _, dfn = by[(r.chain, r.draw, t, a)]
        assert math.isclose(r.lambda_home, math.exp(att - dfn + 0.25), rel_tol=1e-12)


def test_pairs_are_neither_sorted_nor_moved(small):
    draws, fixtures, d = small
    odd = draws.where("not (chain = 0 and draw = 3 and team_id = 2)").union(draws.limit(1).withColumn("team_id", F.lit(None).cast("int")))
    paired = P.pair_draws(P.at_last_step(fixtures, odd), odd)
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("RepartitionByExpression") == 1
    got = paired.where("match_id = 2 and chain = 0 and draw = 3").first()  # team 2 has no strengths there
    others = [a for c, n, t, k, a, *_ in d if (c, n, t) == (0, 3, 2) and k != 2]
    assert paired.count() == 200 and got["home_attack"] == pytest.approx(np.mean(others))


def exact_outcomes(home, away):
    def pmf(rate):
        return np.array([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(rate + 20 * math.sqrt(rate) + 60))])

    n = max(len(pmf(home)), len(pmf(away)))
    grid = np.outer(np.pad(pmf(home), (0, n - len(pmf(home)))), np.pad(pmf(away), (0, n - len(pmf(away)))))
    return [np.tril(grid, -1).sum(), np.trace(grid), np.triu(grid, 1).sum()]


def test_grid_sums_to_one_and_agrees_with_outcomes(spark):
    rates = spark.createDataFrame([(1, 0, i, 1.4, 0.9) for i in range(200)], "match_id long, chain int, draw int, lambda_home double, lambda_away double")
    grid = P.score_grid(rates)
    assert abs(grid.agg(F.sum("probability")).first()[0] - 1) < 1e-9
    h, a = F.col("home_goals"), F.col("away_goals")
    sums = grid.agg(*[F.sum(F.when(c, F.col("probability"))) for c in (h > a, h == a, h < a)]).first()
    out = P.outcome_probabilities(rates).first()
    for k, c in enumerate(("home_win", "draw", "away_win")):
        assert out[c] == pytest.approx(sums[k], abs=1e-9) and out[c] == pytest.approx(exact_outcomes(1.4, 0.9)[k], abs=1e-12)


def test_grid_sums_of_several_matches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(["a", None, "b"][i % 3], i % 2, float(h), float(a)) for i, (h, a) in enumerate(rng.uniform(0, 10, (300, 2)))]
    rows += [("a", 0, None, 1.0), ("zero", 0, 0.0, 0.0), ("large", 0, 800.0, 0.0)]
    rates = spark.createDataFrame(rows, "league string, match_id int, lambda_home double, lambda_away double").coalesce(1)
    monkeypatch.setattr(P, "SUMS_HELD", 0)  # every task passes on what it holds again and again
    got = {(r["league"], r["match_id"], r["home_goals"], r["away_goals"]): r["probability"] for r in P.score_grid(rates, 12, ["league", "match_id"]).collect()}
    assert len(got) == 8 * 169

    def pmf(k, rate):
        return math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)

    for league, match, h, a in (("a", 0, 3, 2), (None, 1, 12, 0), ("b", 0, 0, 12), ("zero", 0, 0, 0), ("zero", 0, 1, 0)):
        held = [(x, y) for l, m, x, y in rows if (l, m) == (league, match) and x is not None]
        assert got[league, match, h, a] == pytest.approx(np.mean([pmf(h, x) * pmf(a, y) for x, y in held]), abs=1e-12)
    assert "explode(" not in P.score_grid(rates)._jdf.queryExecution().optimizedPlan().toString().replace("posexplode(", "")


def test_outcomes_of_large_and_missing_rates(spark):
    rows = [(1, 2.0, 1.0), (1, None, 1.0), (2, 280.0, 270.0), (3, None, None), (4, 0.0, 0.0), (5, 0.0, 3.0), (6, 300.0, 300.0)]
    rates = spark.createDataFrame(rows, "match_id long, lambda_home double, lambda_away double")
    got = {r["match_id"]: r for r in P.outcome_probabilities(rates, largest=300).collect()}
    with pytest.raises(Exception, match="larger bound"):
        P.outcome_probabilities(rates).collect()
    for match, home, away in ((1, 2.0, 1.0), (2, 280.0, 270.0), (6, 300.0, 300.0)):
        want = exact_outcomes(home, away)
        assert [got[match][c] for c in ("home_win", "draw", "away_win")] == pytest.approx(want, abs=1e-9)
    assert got[3]["home_win"] is None and got[4]["draw"] == 1.0 and got[5]["draw"] == pytest.approx(math.exp(-3))
    assert P.goals_to_cover(800.0) > 900 and P.goals_to_cover(0.0) == 1


def test_weights_are_random(spark):
    from touchline.functions import scalars as S

    drawn = spark.range(15_000).select(*[S.poisson_one(S.mixed_uniform(42, F.col("id"), F.lit(r))).alias(f"r{r}") for r in range(1, 41)]).toPandas()
    totals, league = drawn.sum(), drawn.iloc[:380].sum()
    assert 0.4 < totals.var() / 15_000 < 2.0 and 0.4 < league.var() / 380 < 2.0
    pairs = np.corrcoef(drawn.T.to_numpy())[np.triu_indices(40, 1)]
    assert abs(pairs).max() < 0.05 and abs(pairs.mean()) < 0.005


def test_clipped_rates_and_small_grid_report_the_rest(spark):
    rates = spark.createDataFrame([(1, 0, 0, 10.0, 0.01)], "match_id long, chain int, draw int, lambda_home double, lambda_away double")
    small = P.score_grid(rates, 5).agg(F.sum("probability"), F.max("tail"), F.min("tail")).first()
    assert small[0] < 0.1 and small[1] == small[2] == pytest.approx(1 - small[0])
    assert abs(P.score_grid(rates).agg(F.sum("probability")).first()[0] - 1) < 1e-9
    out = P.outcome_probabilities(rates).first()
    assert abs(out["home_win"] + out["draw"] + out["away_win"] - 1) < 1e-12
    # Away goals are 0 with e^-0.01, so the home side fails to win almost only at 0-0.
    assert out["home_win"] > 0.99 and out["draw"] == pytest.approx(math.exp(-10.01) * 1.1, rel=0.01)


def test_prediction_record_shape(small):
    draws, fixtures, _ = small
    rec = P.prediction_records(fixtures, P.goal_rates(fixtures, draws)).orderBy("match_id").first()
    assert len(rec["most_likely_scores"]) == 10 and rec["home_team"] == 0
    probs = [s["probability"] for s in rec["most_likely_scores"]]
    assert probs == sorted(probs, reverse=True)
    assert set(rec["expected_goals_home"].asDict()) == {"mean", "median", "std", "percentile_5", "percentile_95"}
    odds = rec["outcome_probabilities"]
    assert abs(odds["home_win"] + odds["draw"] + odds["away_win"] - 1) < 2e-4


def test_rate_summary_is_exact(small):
    draws, fixtures, _ = small
    rates = P.goal_rates(fixtures, draws)
    got = P.rate_summary(rates).where("match_id = 1 and side = 'away'").first()
    x = rates.where("match_id = 1").toPandas().lambda_away
    assert np.allclose([got[c] for c in ("mean", "std", "p5", "median", "p95")], [x.mean(), x.std(ddof=0), *np.percentile(x, [5, 50, 95])])
    assert got["n_draws"] == 100


def test_every_fixture_meets_every_sample(small, spark):
    draws, fixtures, d = small
    more = fixtures.union(spark.createDataFrame([(3, 2, 0, 99), (4, 1, 98, 99)], fixtures.schema))
    rates = P.goal_rates(more, draws).toPandas()
    assert rates.groupby("match_id").size().to_dict() == {1: 100, 2: 100, 3: 100, 4: 100}
    own = {(c, n, t, k): (a, b) for c, n, t, k, a, b, _ in d}
    row = rates[rates.match_id == 3].iloc[0]
    unseen = np.mean([own[row.chain, row.draw, 1, k][1] for k in range(4)])
    assert row.lambda_home == pytest.approx(math.exp(own[row.chain, row.draw, 1, 0][0] - unseen + 0.25))


def test_fading_sums_equal_direct_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(1, 40)), f"t{rng.integers(3)}", f"u{rng.integers(2)}", int(rng.integers(2)), int(rng.integers(5))) for _ in range(400)]
    df = spark.createDataFrame(rows, "cum_round int, team string, opp_team string, is_home int, goals int")
    for cuts in (range(1, 40), [3, 17, 39, 45]):
        got = {(r["cutoff"], r["decay"], r["team"], r["opp_team"], r["is_home"]): (r["weight"], r["goals"])
               for r in strength.stats_until(df, cuts, decays={"slow": 0.97, "fast": 0.6}).collect()}
        want = {}
        for t, team, opp, home, goals in rows:
            for c in cuts:
                for name, rho in (("slow", 0.97), ("fast", 0.6)):
                    if t <= c:
                        w, g = want.get((c, name, team, opp, home), (0.0, 0.0))
                        want[c, name, team, opp, home] = (w + rho ** (c - t), g + rho ** (c - t) * goals)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)
    with pytest.raises(ValueError):
        strength.stats_until(df, [5000], decays={"fast": 0.6})


def test_unseen_teams_are_scored(spark):
    rows = spark.createDataFrame([("a", "b", 1, 2, 1), ("new", "a", 0, 1, 1)], "team string, opp_team string, is_home int, goals int, goals_against int")
    point = spark.createDataFrame([("a", 0.4, 0.2, 0.3), ("b", 0.0, 0.0, 0.1)], "team string, attack double, defence double, home_adv double")
    got = {r["team"]: r for r in E.strength_predictions(rows, point).collect()}
    assert got["new"]["lambda_home"] == pytest.approx(math.exp(0.2 - 0.2)) and got["a"]["lambda_home"] == pytest.approx(math.exp(0.7))


def test_team_strengths_nested(small):
    draws, _, d = small
    one = {r["team_id"]: r for r in D.nest_strengths(D.team_strengths(draws)).collect()}[2]
    assert [p["t"] for p in one["attack"]] == [0, 1, 2] and one["home_adv"]["mean"] == 0.25
    x = [a for c, n, t, k, a, b, _ in d if t == 1 and k == 2]
    assert one["attack"][1]["p5"] == pytest.approx(np.percentile(x, 5), abs=6e-5)


@pytest.mark.parametrize("rho", [0.0, 0.5, 0.97])
def test_ar1_equals_the_recursion(spark, rho):
    rng = np.random.default_rng(2)
    z = rng.normal(size=3000)
    df = spark.createDataFrame([(0, 0, 0, i, float(v)) for i, v in enumerate(z)], "chain int, draw int, team_id int, t int, z double")
    got = D.ar1_path(df, rho=rho, sigma=0.1).orderBy("t").toPandas().x.to_numpy()
    want = [0.2 * z[0]]
    for v in z[1:]:
        want.append(rho * want[-1] + 0.1 * v)
    assert np.allclose(got, want, atol=1e-12)


def test_subsample_is_repeatable_and_exact_in_size(small):
    draws, fixtures, _ = small
    rates = P.goal_rates(fixtures, draws)
    a, b = (D.subsample(rates, 17).select("match_id", "chain", "draw") for _ in range(2))
    assert a.count() == 34 and a.exceptAll(b.repartition(7)).count() == 0
    assert D.subsample(rates, 1000).count() == 200


def test_subsample_sorts_only_what_a_task_may_keep(spark, small, monkeypatch):
    draws, fixtures, _ = small
    rates = P.goal_rates(fixtures, draws)
    more = rates.withColumn("league", F.when(F.col("chain") == 1, F.lit("x")))
    want = {(r["league"], r["match_id"], r["chain"], r["draw"]) for r in D.subsample(more, 9, by=["match_id", "league"]).collect()}
    assert "mapinarrow" in D.subsample(rates, 9)._jdf.queryExecution().optimizedPlan().toString().lower()
    mixed = D.S.mixed_uniform(42, F.col("match_id"), F.col("chain"), F.col("draw"))
    rows = sorted((r["u"], r["chain"], r["draw"], r["match_id"], r["league"]) for r in more.select("*", mixed.alias("u")).collect())
    plain = {}
    for _, chain, draw, match, league in rows:
        plain.setdefault((league, match), []).append((league, match, chain, draw))
    assert want == {row for group in plain.values() for row in group[:9]} and len(want) == 36


def test_drift_penalty_and_centring(small):
    draws, _, _ = small
    centred = D.centre_over_teams(draws)
    assert centred.groupBy("chain", "draw", "t").agg(F.avg("attack").alias("m")).where("abs(m) > 1e-12").count() == 0
    best = 3 * -0.5 * math.log(2 * math.pi)
    assert all(abs(r["penalty_attack"] - best) < 1e-9 for r in D.drift_penalty(centred).collect())


def test_pointwise_loglik_is_log_mean_likelihood(spark):
    data = [(1, 2, 1, 1.5, 0.7), (1, 2, 1, 2.5, 1.1), (2, 30, 0, 0.01, 9.0)]
    df = spark.createDataFrame(data, "obs_id int, goals_home int, goals_away int, lambda_home double, lambda_away double")
    got = {r["obs_id"]: r["log_mean_likelihood"] for r in P.pointwise_loglik(df).collect()}
    pmf = lambda k, r: math.exp(k * math.log(r) - r - math.lgamma(k + 1))
    assert got[1] == pytest.approx(math.log((pmf(2, 1.5) * pmf(1, 0.7) + pmf(2, 2.5) * pmf(1, 1.1)) / 2))
    assert got[2] == pytest.approx(30 * math.log(0.01) - 0.01 - math.lgamma(31) - 9.0)


def test_cross_validation_beats_the_naive_baseline(rows):
    windows = E.cv_windows(rows, min_train=25, test_window=3, step=3)
    scores = E.cv_scores(rows, windows, prior=2.0)
    assert scores.count() == windows.count() == 6
    out = E.cv_summary(scores).first()
    assert out["gain_mean"] > 0 and 0.5 < out["mae_mean"] < 1.5
    sizes = E.cv_window_sizes(rows, windows).orderBy("window").first()
    assert (sizes["n_train"], sizes["n_test"]) == (150, 18)


def test_windows_need_enough_rounds(rows):
    assert E.cv_windows(rows, min_train=100).count() == 0
    last = E.cv_windows(rows, min_train=25, test_window=1, step=1).agg(F.max("test_end")).first()[0]
    assert last == 44


def test_unseen_team_falls_back_to_the_average(rows):
    train, test = F.col("cum_round") <= 20, F.col("cum_round") > 40
    out = E.team_average_predictions(rows.where("cum_round > 40 or team <> 'T00'").where("cum_round > 40 or opp_team <> 'T00'"), train, test)
    assert out.where("lambda_home is null or lambda_away is null").count() == 0


def test_backtest_uses_only_earlier_rounds(rows):
    a = E.season_backtest(rows, [30], steps=3, tolerance=0).orderBy("match_id").toPandas()
    changed = rows.withColumn("goals", F.when(F.col("round") >= 30, 9).otherwise(F.col("goals")))
    b = E.season_backtest(changed, [30], steps=3, tolerance=0).orderBy("match_id").toPandas()
    assert len(a) == 6 and np.allclose(a.lambda_home, b.lambda_home) and (b.goals_home == 9).all()


def test_bayes_factor_overflow_keeps_log10(spark):
    m = spark.createDataFrame([(-100.0,)], "log_likelihood double")
    b = spark.createDataFrame([(-2000.0,)], "log_likelihood double")
    out = E.bayes_factor(m, b).first()
    assert out["bayes_factor"] == float("inf") and out["log10_bayes_factor"] == pytest.approx(1900 / math.log(10))


def chains(spark, shift=0.0, n=400, rho=0.0, seed=4):
    rng = np.random.default_rng(seed)
    data = []
    for c in range(4):
        x = 0.0
        for i in range(1, n + 1):
            x = rho * x + rng.normal()
            data.append(("p", c, i, float(x + shift * c)))
    return spark.createDataFrame(data, "param string, chain int, draw int, x double"), np.array([d[3] for d in data]).reshape(4, n)


def ess_reference(x):
    m, n = x.shape
    mean = x.mean(1, keepdims=True)
    d = x - mean
    acov = np.array([[(d[c, : n - k] * d[c, k:]).sum() / n for k in range(n)] for c in range(m)]).mean(0)
    w = acov[0] * n / (n - 1)
    plus = w * (n - 1) / n + x.mean(1).var(ddof=1)
    rho = 1 - (w - acov) / plus
    rho[0] = 1
    total, last = 0.0, math.inf
    for k in range(0, n - 1, 2):
        p = rho[k] + rho[k + 1]
        if p <= 0:
            break
        last = min(last, p)
        total += last
    return m * n / max(2 * total - 1, 1 / math.log10(m * n))


@pytest.mark.parametrize("ranks", [False, True])
def test_rhat_near_one_or_large(spark, ranks):
    good = G.split_rhat(chains(spark)[0], ranks, 0.1).first()["r_hat"]
    bad = G.split_rhat(chains(spark, shift=1.0)[0], ranks, 0.1).first()["r_hat"]
    assert abs(good - 1) < 0.03 and bad > 1.1


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [0.0001, 0.01, 0.0249, 0.3, 0.5, 0.9, 0.9755, 0.99999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(G.normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)


@pytest.mark.parametrize("rho", [0.0, 0.6, 0.98])
def test_effective_sample_size(spark, rho):
    df, x = chains(spark, rho=rho)
    assert G.effective_sample_size(df, start_lags=7).first()["ess"] == pytest.approx(ess_reference(x), rel=1e-9)


def test_shortest_interval_equals_brute_force(spark):
    df, x = chains(spark)
    s = np.sort(x.ravel())
    k = int(0.94 * len(s))
    i = np.argmin(s[k:] - s[: len(s) - k])
    out = G.shortest_interval(df, bin_width=0.05).first()
    assert (out["hdi_low"], out["hdi_high"]) == (s[i], s[i + k])


def test_identical_chains_and_constant_parameter(spark):
    df = spark.createDataFrame([("p", c, i, 1.0) for c in range(2) for i in range(1, 9)], "param string, chain int, draw int, x double")
    assert G.split_rhat(df).first()["r_hat"] is None


def test_summary_tables(spark):
    s = spark.createDataFrame([("attack[0]", 1.2), ("attack[1]", 1.0), ("rho_att", 1.03), ("x", None)], "param string, r_hat double")
    assert [r["param"] for r in G.worst_rhat(s, 2).collect()] == ["attack[0]", "rho_att"]
    assert {r["param_type"]: (r["n_bad"], r["n_total"]) for r in G.rhat_by_type(s, ["attack", "rho", "none"]).collect()} == {"attack": (1, 2), "rho": (1, 1)}
    assert G.rhat_counts(s).first().asDict() == {"above_1_01": 2, "above_1_05": 1, "n_params": 4}
    assert G.key_parameters(s, ["rho_att"]).count() == 1
