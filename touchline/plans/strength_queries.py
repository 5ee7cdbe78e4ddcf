"""Queries: strength estimation to convergence. The SQL repeats the same sweeps in a recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators import strength
from touchline.plans import fixtures as fx
from touchline.plans.registry import query, sql

LR = ("m", "l0", "l", "wk", "rnd", "off", "cal", "lr")
PRIOR = 5.0
#: Sweeps of the SQL; by then no strength changes in double precision.
SWEEPS = 50
DECAY = 29.0 / 30.0
ABILITY, FORM = 49.0 / 50.0, 8.0 / 9.0


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def fit_ctes(group: list[str], stats: str = "ss", steps: int = SWEEPS, prior: float = PRIOR) -> str:
    """Sweeps over relation `stats` (group, team, opp_team, is_home, weight, goals) as a recursion; last state is `st`."""
    g = "".join(f"{c}, " for c in group)
    part = f"PARTITION BY {', '.join(group)}" if group else ""
    p = num(prior)

    def on(a: str, b: str, extra: str) -> str:
        return " AND ".join([*[f"{a}.{c} = {b}.{c}" for c in group], extra])

    def cols(alias: str) -> str:
        return "".join(f"{alias}.{c}, " for c in group)

    first = f"""SELECT 0 AS k, {g}team, sum(scored) AS scored, sum(conceded) AS conceded, sum(sum(gh)) OVER ({part}) AS gh, sum(sum(ga)) OVER ({part}) AS ga,
  {num(1.0)} AS att, {num(1.0)} AS dfn, (sum(sum(gh)) OVER ({part}) + sum(sum(ga)) OVER ({part})) / sum(sum(w)) OVER ({part}) AS mu, {num(1.0)} AS home
FROM (SELECT {g}team, goals AS scored, 0 AS conceded, CASE WHEN is_home = 1 THEN goals ELSE 0 END AS gh, CASE WHEN is_home = 1 THEN 0 ELSE goals END AS ga, weight AS w FROM {stats}
  UNION ALL SELECT {g}opp_team, 0, goals, 0, 0, 0 FROM {stats}) e GROUP BY {g}team"""
    sweep = f"""SELECT k + 1, {g}team, scored, conceded, gh, ga, att1 / exp(la), dfn1 / exp(ld), ga / ea * exp(la + ld), gh / (ga / ea * eh) FROM (
SELECT *, avg(ln(att1)) OVER ({part}) AS la, avg(ln(dfn1)) OVER ({part}) AS ld, sum(dfn1 * dh) OVER ({part}) AS eh, sum(dfn1 * da) OVER ({part}) AS ea FROM (
WITH u AS MATERIALIZED (SELECT z.*, ({p} + scored) / ({p} + mu * (home * coalesce(ah, 0) + coalesce(aa, 0))) AS att1 FROM it z LEFT JOIN (
    SELECT {cols('s')}s.team, sum(CASE WHEN is_home = 1 THEN weight * dfn ELSE 0 END) AS ah, sum(CASE WHEN is_home = 1 THEN 0 ELSE weight * dfn END) AS aa
    FROM {stats} s JOIN it o ON {on('s', 'o', 's.opp_team = o.team')} GROUP BY {cols('s')}s.team) a ON {on('z', 'a', 'z.team = a.team')} WHERE k < {steps})
SELECT u.*, coalesce(dh, 0) AS dh, coalesce(da, 0) AS da, ({p} + conceded) / ({p} + mu * (home * coalesce(dh, 0) + coalesce(da, 0))) AS dfn1 FROM u LEFT JOIN (
    SELECT {cols('s')}s.opp_team AS team, sum(CASE WHEN is_home = 1 THEN weight * att1 ELSE 0 END) AS dh, sum(CASE WHEN is_home = 1 THEN 0 ELSE weight * att1 END) AS da
    FROM {stats} s JOIN u o ON {on('s', 'o', 's.team = o.team')} GROUP BY {cols('s')}s.opp_team) b ON {on('u', 'b', 'u.team = b.team')}))"""
    return f"it AS ({first} UNION ALL {sweep}),\nst AS MATERIALIZED (SELECT * FROM it WHERE k = {steps})"


SS = "ss AS MATERIALIZED (SELECT {g}team, opp_team, is_home, CAST(count(*) AS DOUBLE) AS weight, CAST(sum(goals) AS DOUBLE) AS goals FROM lr GROUP BY {g}team, opp_team, is_home)"
OUT = "round(ln(att), 6) AS attack, round(-ln(dfn), 6) AS defence, round(ln(mu), 6) AS level, round(ln(home), 6) AS home"


def rounded(df, *columns: str, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def spaced(spark, sf, first: int, step: int) -> list[int]:
    """Every `step`-th round from `first`; one number per round, so small by nature."""
    last = fx.rounded_matches(spark, sf).agg(F.max("cum_round")).first()[0]
    return list(range(first, last, step))


def cut_ctes(first: int, step: int, decays: dict[str, float], keep_name: bool) -> str:
    """Decayed sums at every cut-off as relation `ss`."""
    pick = " UNION ALL ".join(f"SELECT '{n}' AS decay, {num(d)} AS rho" for n, d in decays.items())
    name = "decay, " if keep_name else ""
    return f"""cuts AS (SELECT CAST(unnest(range({first}, (SELECT max(cum_round) FROM cal), {step})) AS INT) AS cutoff), dec AS ({pick}),
pt AS (SELECT team, opp_team, is_home, cum_round AS t, count(*) AS n, sum(goals) AS g FROM lr GROUP BY 1, 2, 3, 4),
ss AS MATERIALIZED (SELECT cutoff, {name}team, opp_team, is_home, sum(pow(rho, cutoff - t) * n) AS weight, sum(pow(rho, cutoff - t) * g) AS goals
  FROM pt JOIN cuts ON t <= cutoff CROSS JOIN dec GROUP BY cutoff, {name}team, opp_team, is_home)"""


@query("strength_suffstats", sql("""SELECT season, team, opp_team, is_home, CAST(count(*) AS DOUBLE) AS weight, CAST(sum(goals) AS DOUBLE) AS goals
FROM lr GROUP BY 1, 2, 3, 4""", *LR))
def strength_suffstats(spark, sf):
    return strength.suffstats(fx.team_rows(spark, sf), ["season"])


@query("strength_fit", sql(f"CTE {SS.format(g='season, ')}, {fit_ctes(['season'])} SELECT season, team, {OUT} FROM st", *LR, recursive=True))
def strength_fit(spark, sf):
    stats = strength.suffstats(fx.team_rows(spark, sf), ["season"])
    fit = strength.fit_strengths(stats, ["season"], prior=PRIOR)
    return rounded(fit, "attack", "defence", "level", "home")


@query("strength_convergence", sql(f"""CTE {SS.format(g='season, ')}, {fit_ctes(['season'])}
SELECT st.season, CAST(count(*) AS BIGINT) AS n_teams, bool_and(abs(ln(st.att / b.att)) < 1e-10 AND abs(ln(st.dfn / b.dfn)) < 1e-10) AS converged
FROM st JOIN it b ON b.season = st.season AND b.team = st.team AND b.k = st.k - 1 GROUP BY 1""", *LR, recursive=True))
def strength_convergence(spark, sf):
    _, state = strength.fit_state(strength.suffstats(fx.team_rows(spark, sf), ["season"]), ["season"], prior=PRIOR)
    teams = state.groupBy("season").agg(F.count(F.lit(1)).alias("n_teams"))
    return teams.join(strength.convergence(state, ["season"]).select("season", "converged"), "season")


@query("strength_by_round", sql(f"CTE {cut_ctes(1, 1, {'all': DECAY}, False)}, {fit_ctes(['cutoff'])} SELECT cutoff, team, {OUT} FROM st", *LR, recursive=True))
def strength_by_round(spark, sf):
    rows = fx.rounded_rows(spark, sf)
    fit = strength.strengths_by_round(rows, spaced(spark, sf, 1, 1), decay=DECAY, prior=PRIOR)
    return rounded(fit, "attack", "defence", "level", "home")


@query("ability_form", sql(f"""CTE {cut_ctes(1, 1, {'ability': ABILITY, 'fast': FORM}, True)}, {fit_ctes(['cutoff', 'decay'])}
SELECT a.cutoff, a.team, round(ln(a.att), 5) AS attack_ability, round(ln(f.att) - ln(a.att), 5) AS attack_form, round(-ln(a.dfn), 5) AS defence_ability,
  round(-ln(f.dfn) + ln(a.dfn), 5) AS defence_form FROM st a JOIN st f ON a.cutoff = f.cutoff AND a.team = f.team WHERE a.decay = 'ability' AND f.decay = 'fast'""", *LR, recursive=True))
def ability_form(spark, sf):
    rows = fx.rounded_rows(spark, sf)
    out = strength.ability_form(rows, spaced(spark, sf, 1, 1), slow=ABILITY, fast=FORM, prior=PRIOR)
    return rounded(out, "attack_ability", "attack_form", "defence_ability", "defence_form", digits=5)


POISSON_ONE = " + ".join(f"CASE WHEN u >= {num(s)} THEN 1 ELSE 0 END" for s in S.poisson_steps(1.0))
BOOT = f"""bw AS (SELECT match_no, r AS replicate, CAST(CAST('0x' || substr(md5('42|' || match_no || '|' || r), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496.0 AS DOUBLE) AS u
  FROM m, (SELECT unnest(range(1, 21)) AS r) rs),
ss AS MATERIALIZED (SELECT replicate, team, opp_team, is_home, CAST(sum({POISSON_ONE}) AS DOUBLE) AS weight, CAST(sum(({POISSON_ONE}) * goals) AS DOUBLE) AS goals
  FROM l JOIN bw ON l.match_no = bw.match_no GROUP BY 1, 2, 3, 4)"""
HOME = """hosted AS (SELECT {s}s.team, sum(goals) AS g, sum(weight * dfn) AS e FROM ss s JOIN st o ON {on}s.opp_team = o.team WHERE is_home = 1 GROUP BY {s}s.team),
ha AS (SELECT st.*, ln((CAST(20.0 AS DOUBLE) * home + coalesce(g, 0)) / (CAST(20.0 AS DOUBLE) + coalesce(mu * att * e, 0))) AS home_adv FROM st LEFT JOIN hosted h ON {on2}st.team = h.team)"""


@query("strength_draws", sql(f"""CTE {BOOT}, {fit_ctes(['replicate'])}, {HOME.format(s='s.replicate, ', on='s.replicate = o.replicate AND ', on2='st.replicate = h.replicate AND ')}
SELECT 0 AS chain, CAST(replicate AS INT) AS draw, 0 AS t, team AS team_id, round(ln(att) + ln(mu), 6) AS attack, round(-ln(dfn), 6) AS defence, round(home_adv, 6) AS home_adv FROM ha""", *LR, recursive=True))
def strength_draws(spark, sf):
    draws = strength.bootstrap_draws(fx.team_rows(spark, sf), "match_no", 20, prior=PRIOR, pool=20.0)
    return rounded(draws, "attack", "defence", "home_adv")


@query("home_advantage", sql(f"CTE {SS.format(g='')}, {fit_ctes([])}, {HOME.format(s='', on='', on2='')} SELECT team, round(home, 6) AS home, round(home_adv, 6) AS home_adv FROM (SELECT team, ln(home) AS home, home_adv FROM ha)", *LR, recursive=True))
def home_advantage(spark, sf):
    fit = strength.home_advantage(strength.suffstats(fx.team_rows(spark, sf)), prior=PRIOR, pool=20.0)
    return rounded(fit.select("team", "home", "home_adv"), "home", "home_adv")


#: The same optimum by coordinate steps: teams, opponents, level and home exactly in turn, then one Newton step of the slope.
#: At the optimum the effects' factors have mean 1, so they are scaled to it, which speeds the level up.
SLOPE = f"""ro AS MATERIALIZED (SELECT season, team, opp_team, is_home, goals AS y, ln(xg_c / 100.0::DOUBLE + {num(0.01)}) AS x0 FROM lr),
rx AS MATERIALIZED (SELECT r.*, x0 - xm AS x, xm FROM ro r JOIN (SELECT season, avg(x0) AS xm FROM ro GROUP BY 1) z ON z.season = r.season),
it AS (SELECT 0 AS k, season, kind, team, {num(0.0)} AS v FROM (SELECT DISTINCT season, 'a' AS kind, team FROM rx UNION SELECT DISTINCT season, 'c', opp_team FROM rx
    UNION SELECT DISTINCT season, unnest(['m', 'h', 'b']), NULL FROM rx) e
UNION ALL SELECT * FROM (WITH hd AS MATERIALIZED (SELECT season, max(k) AS k, max(CASE WHEN kind = 'm' THEN v END) AS m, max(CASE WHEN kind = 'h' THEN v END) AS h, max(CASE WHEN kind = 'b' THEN v END) AS b
    FROM it GROUP BY 1),
  ra AS MATERIALIZED (SELECT r.season, r.team, r.opp_team, r.is_home, y, x, m, h, b, c.v AS c, hd.k FROM rx r JOIN hd ON hd.season = r.season JOIN it c ON c.kind = 'c' AND c.season = r.season AND c.team = r.opp_team WHERE hd.k < SLOPES),
  na AS MATERIALIZED (SELECT season, team, ln(({num(PRIOR)} + sum(y)) / ({num(PRIOR)} + sum(exp(m + c + h * is_home + b * x)))) AS w, w - ln(avg(exp(w)) OVER (PARTITION BY season)) AS v FROM ra GROUP BY 1, 2),
  rb AS MATERIALIZED (SELECT ra.*, na.v AS a FROM ra JOIN na ON na.season = ra.season AND na.team = ra.team),
  nc AS MATERIALIZED (SELECT season, opp_team AS team, ln(({num(PRIOR)} + sum(y)) / ({num(PRIOR)} + sum(exp(m + a + h * is_home + b * x)))) AS w, w - ln(avg(exp(w)) OVER (PARTITION BY season)) AS v FROM rb GROUP BY 1, 2),
  rd AS MATERIALIZED (SELECT rb.*, nc.v AS d, exp(a + nc.v + b * x) AS e FROM rb JOIN nc ON nc.season = rb.season AND nc.team = rb.opp_team),
  nh AS MATERIALIZED (SELECT season, max(k) AS k, ln(sum(CASE WHEN is_home = 0 THEN y END) / sum(CASE WHEN is_home = 0 THEN e END)) AS m,
    ln(sum(CASE WHEN is_home = 1 THEN y END) / sum(CASE WHEN is_home = 1 THEN e END)) - ln(sum(CASE WHEN is_home = 0 THEN y END) / sum(CASE WHEN is_home = 0 THEN e END)) AS h FROM rd GROUP BY 1),
  nb AS MATERIALIZED (SELECT rd.season, max(rd.b) + sum((y - e * exp(nh.m + nh.h * is_home)) * x) / sum(e * exp(nh.m + nh.h * is_home) * x * x) AS b FROM rd JOIN nh ON nh.season = rd.season GROUP BY 1)
  SELECT nh.k + 1, na.season, 'a', na.team, na.v FROM na JOIN nh ON nh.season = na.season UNION ALL SELECT nh.k + 1, nc.season, 'c', nc.team, nc.v FROM nc JOIN nh ON nh.season = nc.season
  UNION ALL SELECT k + 1, season, 'm', NULL, m FROM nh UNION ALL SELECT k + 1, season, 'h', NULL, h FROM nh UNION ALL SELECT nh.k + 1, nb.season, 'b', NULL, b FROM nb JOIN nh ON nh.season = nb.season))""".replace("SLOPES", "80")


@query("xg_weight", sql(f"""CTE {SLOPE}, en AS (SELECT season, max(CASE WHEN kind = 'm' THEN v END) AS m, max(CASE WHEN kind = 'h' THEN v END) AS h, max(CASE WHEN kind = 'b' THEN v END) AS b FROM it WHERE k = 80 GROUP BY 1),
xm AS (SELECT season, max(xm) AS xm FROM rx GROUP BY 1)
SELECT en.season, unnest(['xg_weight', 'home', 'intercept']) AS parameter, round(unnest([b, h, m - b * xm]), 6) AS estimate FROM en JOIN xm ON xm.season = en.season""", *LR, recursive=True))
def xg_weight(spark, sf):
    rows = fx.team_rows(spark, sf).withColumn("xG", F.col("xg_c") / 100)
    return rounded(strength.xg_weight(rows, group=["season"], prior=PRIOR).drop("standard_error"), "estimate")
