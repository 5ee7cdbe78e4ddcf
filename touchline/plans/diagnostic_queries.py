"""Queries: convergence diagnostics and the admission rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import diagnostics as G
from touchline.operators.cells import Track, running
from touchline.plans import fixtures as fx
from touchline.plans.registry import query, sql, view
from touchline.plans.strength_queries import num, rounded
from touchline.streaming import admission

view("dg", """SELECT event_type AS param, CAST(user_id % 4 AS INT) AS chain, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS draw, cents AS x FROM ev""")
view("dm", """SELECT event_type || '_' || (user_id // 4) % 10 AS param, CAST(user_id % 4 AS INT) AS chain,
  row_number() OVER (PARTITION BY event_type, (user_id // 4) % 10, user_id % 4 ORDER BY ts, event_id) AS draw, cents AS x FROM ev""")


def rhat_sql(source: str) -> str:
    return f"""len AS (SELECT param, chain, count(*) AS n FROM {source} GROUP BY 1, 2),
hv AS (SELECT d.param, d.chain, CASE WHEN draw > n // 2 THEN 1 ELSE 0 END AS half, x FROM {source} d JOIN len ON d.param = len.param AND d.chain = len.chain),
pt AS (SELECT param, chain, half, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM hv GROUP BY 1, 2, 3),
rh AS (SELECT param, sqrt(((avg(n) - 1) / avg(n) * avg(var) + var_samp(mean)) / nullif(avg(var), 0)) AS r_hat FROM pt GROUP BY 1)"""


def draws(spark, sf, many: bool = False):
    """Events as draws: the type (with a user group, if `many`) is the parameter, time gives the order."""
    e = fx.events(spark, sf)
    name = F.concat_ws("_", "event_type", (F.floor(F.col("user_id") / 4) % 10).cast("string")) if many else F.col("event_type")
    rows = e.select(name.alias("param"), (F.col("user_id") % 4).cast("int").alias("chain"), "ts", "event_id", F.col("cents").alias("x"))
    return running(rows, Track(["param", "chain"], "ts", ("event_id",)), position="draw").drop("ts", "event_id")


@query("split_rhat", sql(f"CTE {rhat_sql('dg')} SELECT param, round(r_hat, 8) AS r_hat FROM rh", "ev", "dg"))
def split_rhat(spark, sf):
    return rounded(G.split_rhat(draws(spark, sf)), "r_hat", digits=8)


@query("worst_rhat", sql(f"CTE {rhat_sql('dm')} SELECT param, round(r_hat, 8) AS r_hat FROM rh ORDER BY round(r_hat, 9) DESC NULLS LAST, param LIMIT 20", "ev", "dm"))
def worst_rhat(spark, sf):
    return rounded(G.worst_rhat(G.split_rhat(draws(spark, sf, many=True)), 20), "r_hat", digits=8)


@query("rhat_by_type", sql(f"""CTE {rhat_sql('dm')}, ty AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'absent']) AS param_type)
SELECT param_type, CAST(count(*) FILTER (WHERE r_hat > {num(1.01)}) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_total FROM rh JOIN ty ON contains(param, param_type) GROUP BY 1""", "ev", "dm"))
def rhat_by_type(spark, sf):
    types = ["view", "click", "purchase", "signup", "error", "absent"]
    return G.rhat_by_type(G.split_rhat(draws(spark, sf, many=True)), types)


@query("draw_summary", sql("""CTE len AS (SELECT param, chain, count(*) AS n FROM dg GROUP BY 1, 2),
b AS (SELECT d.param, d.chain, floor((draw - 1) * 10 / n) AS bt, avg(x) AS m FROM dg d JOIN len ON d.param = len.param AND d.chain = len.chain GROUP BY 1, 2, 3),
e AS (SELECT param, stddev_samp(m) / sqrt(count(*)) AS mcse FROM b GROUP BY 1)
SELECT d.param, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(max(mcse), 6) AS mcse_mean FROM dg d JOIN e ON d.param = e.param GROUP BY 1""", "ev", "dg"))
def draw_summary(spark, sf):
    return rounded(G.draw_summary(draws(spark, sf)), "mean", "sd", "mcse_mean")


@query("shortest_interval", sql("""CTE r AS (SELECT param, x, row_number() OVER (PARTITION BY param ORDER BY x, chain, draw) AS pos, count(*) OVER (PARTITION BY param) AS n FROM dg),
p AS (SELECT a.param, a.pos, a.x AS lo, b.x AS hi, row_number() OVER (PARTITION BY a.param ORDER BY b.x - a.x, a.pos) AS rn FROM r a JOIN r b ON a.param = b.param AND b.pos = a.pos + CAST(floor(0.94::DOUBLE * a.n) AS BIGINT))
SELECT param, lo AS hdi_low, hi AS hdi_high FROM p WHERE rn = 1""", "ev", "dg"))
def shortest_interval(spark, sf):
    return G.shortest_interval(draws(spark, sf), bin_width=100.0)


@query("effective_sample_size", sql("""CTE s AS (SELECT param, chain, count(*) AS n, avg(x) AS mean FROM dg GROUP BY 1, 2),
c AS (SELECT d.param, d.chain, d.draw, d.x - s.mean AS d, n FROM dg d JOIN s ON d.param = s.param AND d.chain = s.chain),
lg AS (SELECT CAST(unnest(range(0, 64)) AS BIGINT) AS k),
ac AS (SELECT a.param, a.chain, k, sum(a.d * b.d) / max(a.n) AS c FROM c a CROSS JOIN lg JOIN c b ON a.param = b.param AND a.chain = b.chain AND b.draw = a.draw + k GROUP BY 1, 2, 3),
g AS (SELECT param, avg(n) AS n, sum(n) AS total, coalesce(var_samp(mean), 0) AS b FROM s GROUP BY 1),
w AS (SELECT ac.param, avg(c * n / (n - 1)) AS w FROM ac JOIN s ON ac.param = s.param AND ac.chain = s.chain WHERE k = 0 GROUP BY 1),
rho AS (SELECT ac.param, k, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 1 - (max(w) - avg(c)) / (max(w) * (max(n) - 1) / max(n) + max(b)) END AS r FROM ac JOIN w ON ac.param = w.param JOIN g ON ac.param = g.param GROUP BY 1, 2),
pr AS (SELECT param, k // 2 AS j, sum(r) AS p FROM rho GROUP BY 1, 2),
fs AS (SELECT param, coalesce(min(CASE WHEN p <= 0 THEN j END), 32) AS stop FROM pr GROUP BY 1),
mn AS (SELECT pr.param, min(p) OVER (PARTITION BY pr.param ORDER BY j) AS p FROM pr JOIN fs ON pr.param = fs.param WHERE j < stop)
SELECT mn.param, CAST(max(total) AS BIGINT) AS n_draws, round(max(total) / greatest(2 * sum(p) - 1, 1 / log10(max(total))), 4) AS ess FROM mn JOIN g ON mn.param = g.param GROUP BY 1""", "ev", "dg"))
def effective_sample_size(spark, sf):
    return rounded(G.effective_sample_size(draws(spark, sf)), "ess", digits=4)


@query("sampler_stats", sql("""SELECT chain, CAST(sum(cents) AS DOUBLE) / count(*) AS acceptance_rate, arg_max(cents, rn) AS last_step_size, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS divergences, CAST(count(*) AS BIGINT) AS n_draws
FROM (SELECT *, CAST(user_id % 4 AS INT) AS chain, event_id AS rn FROM ev) e GROUP BY 1""", "ev"))
def sampler_stats(spark, sf):
    stats = fx.events(spark, sf).select(
        (F.col("user_id") % 4).cast("int").alias("chain"), F.col("event_id").alias("draw"), F.col("cents").alias("acceptance_rate"),
        F.col("cents").alias("step_size"), (F.col("event_type") == "error").alias("diverging"),
    )
    return G.sampler_stats(stats)


@query("admission_filter", sql("""CTE o AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev),
f AS (SELECT user_id, rn, event_id, us AS t1, CAST(NULL AS BIGINT) AS t2, TRUE AS ok FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, o.event_id,
    CASE WHEN f.t2 IS NULL OR o.us - f.t2 >= 21600000000 THEN o.us ELSE f.t1 END,
    CASE WHEN f.t2 IS NULL OR o.us - f.t2 >= 21600000000 THEN f.t1 ELSE f.t2 END,
    f.t2 IS NULL OR o.us - f.t2 >= 21600000000 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, event_id FROM f WHERE ok""", "ev", recursive=True))
def admission_filter(spark, sf):
    return admission.admit(fx.events(spark, sf), key="user_id", ts="ts", event_id="event_id", limit=2, window_seconds=6 * 3600)
