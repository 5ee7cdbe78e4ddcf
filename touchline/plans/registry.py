"""Query registry: a Spark callable per name and, where SQL can express it, the equivalent ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared table expressions, each listing what it builds on. Kept in dependency order.
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """`body` preceded by the named views, in the order they were declared."""
    chosen = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in views]
    if not chosen:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    joiner = ", " if body.lstrip().upper().startswith("CTE ") else " "
    text = body.lstrip()[4:] if joiner == ", " else body
    return head + ",\n".join(chosen) + joiner + text


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


view(
    "m",
    """SELECT o.o_orderkey AS match_no, o.o_orderdate AS datetime, CAST(year(o.o_orderdate) AS VARCHAR) AS season,
  c.c_nationkey AS home, CAST((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS INT) AS away,
  CAST((o.o_orderkey*7 + o.o_custkey) % 5 AS INT) AS goals_home,
  CAST((o.o_orderkey*3 + o.o_custkey) % 4 AS INT) AS goals_away,
  CAST((o.o_orderkey*13 + o.o_custkey) % 301 AS BIGINT) AS xg_home_c,
  CAST((o.o_orderkey*17 + o.o_custkey) % 251 AS BIGINT) AS xg_away_c
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
view(
    "l0",
    """SELECT match_no, datetime, season, home AS team, away AS opp_team, 1 AS is_home, goals_home AS goals,
  goals_away AS goals_against, xg_home_c AS xg_c, xg_away_c AS xga_c FROM m
UNION ALL
SELECT match_no, datetime, season, away, home, 0, goals_away, goals_home, xg_away_c, xg_home_c FROM m""",
)
view(
    "l",
    """SELECT *, CASE WHEN goals > goals_against THEN 1 ELSE 0 END AS win,
  CASE WHEN goals < goals_against THEN 1 ELSE 0 END AS loss,
  CASE WHEN goals = goals_against THEN 1 ELSE 0 END AS draw, goals - goals_against AS gd FROM l0""",
)
view("wk", "SELECT DISTINCT season, date_trunc('week', datetime - INTERVAL 1 DAY) AS wk FROM m")
view("rnd", "SELECT season, wk, row_number() OVER (PARTITION BY season ORDER BY wk) AS round_in_season FROM wk")
view(
    "off",
    """SELECT season, count(*) AS rounds,
  coalesce(sum(count(*)) OVER (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS round_offset
FROM rnd GROUP BY season""",
)
view(
    "cal",
    """SELECT rnd.season, wk, CAST(round_in_season AS INT) AS round_in_season,
  CAST(round_in_season + round_offset AS INT) AS cum_round FROM rnd JOIN off ON rnd.season = off.season""",
)
view(
    "mr",
    """SELECT m.*, cal.round_in_season, cal.cum_round FROM m JOIN cal
  ON m.season = cal.season AND date_trunc('week', m.datetime - INTERVAL 1 DAY) = cal.wk""",
)
view(
    "lr",
    """SELECT l.*, cal.round_in_season, cal.cum_round FROM l JOIN cal
  ON l.season = cal.season AND date_trunc('week', l.datetime - INTERVAL 1 DAY) = cal.wk""",
)
view(
    "ratings",
    """SELECT c_nationkey AS team, o_orderdate AS valid_from, max(o_orderkey) AS rating
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
view(
    "ev",
    """SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS win, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS draw
FROM events""",
)
view("evp", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ev")
view("lp", "SELECT *, row_number() OVER (PARTITION BY team ORDER BY datetime, match_no) AS pos FROM lr")
view(
    "dr",
    """SELECT CAST(vec_id % 4 AS INT) AS chain, CAST(vec_id // 20 AS INT) AS draw, CAST((vec_id // 4) % 5 AS INT) AS t,
  CAST(k AS INT) AS team_id, CAST(embedding[k + 1] AS DOUBLE) AS attack, CAST(embedding[k + 26] AS DOUBLE) AS defence,
  0.25::DOUBLE + CAST(embedding[k % 14 + 51] AS DOUBLE) * 0.125::DOUBLE AS home_adv
FROM embeddings, (SELECT unnest(range(25)) AS k) ks""",
)
view(
    "fx",
    """SELECT DISTINCT CAST((CAST(season AS INT) - 1995) * 10000 + home * 100 + away AS BIGINT) AS match_id,
  CAST(season AS INT) - 1994 AS round, home AS home_id, away AS away_id FROM m""",
)
view(
    "rates",
    """SELECT match_id, h.chain, h.draw,
  greatest(0.01::DOUBLE, least(10.0::DOUBLE, exp(h.attack - a.defence + h.home_adv))) AS lambda_home,
  greatest(0.01::DOUBLE, least(10.0::DOUBLE, exp(a.attack - h.defence))) AS lambda_away
FROM fx JOIN dr h ON h.t = least(fx.round - 1, 4) AND h.team_id = fx.home_id
JOIN dr a ON a.t = h.t AND a.chain = h.chain AND a.draw = h.draw AND a.team_id = fx.away_id""",
)
