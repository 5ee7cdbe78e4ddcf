"""Convergence diagnostics over long draws: rows of (param, chain, draw, x), draw 1-based per chain.

A parameter may hold most of the rows: statistics are sums combined map-side, ranks come from counted
values, and lagged products are taken inside blocks of draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.cells import Track, looking_back, quantiles, running
from touchline.session import settle, small_side

CHAIN = ["param", "chain"]
# Coefficients of Acklam's rational approximation of the normal quantile.
CENTRE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_BOTTOM = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for p in (0, 1)."""
    q = p - 0.5
    centre = q * _horner(CENTRE_TOP, q * q) / _horner(CENTRE_BOTTOM, q * q)
    low = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(TAIL_TOP, low) / _horner(TAIL_BOTTOM, low)
    return F.when(F.abs(q) <= 0.47575, centre).when(p < 0.5, tail).otherwise(-tail)


def _halves(draws: DataFrame) -> DataFrame:
    """Tag each draw with the half of its chain; with an odd length the first half is the shorter."""
    length = small_side(draws.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("_length")))
    return draws.join(length, CHAIN).withColumn("half", (F.col("draw") > F.floor(F.col("_length") / 2)).cast("int")).drop("_length")


def _rhat(parts: DataFrame, name: str) -> DataFrame:
    """Between / within variance ratio from one row per (param, chain, half): n, mean, var."""
    agg = parts.groupBy("param").agg(
        F.avg("n").alias("_n"), F.avg("var").alias("_within"), F.var_samp("mean").alias("_between")
    )
    pooled = (F.col("_n") - 1) / F.col("_n") * F.col("_within") + F.col("_between")
    return agg.select("param", F.sqrt(F.try_divide(pooled, F.col("_within"))).alias(name))


def split_rhat(draws: DataFrame, rank_normalised: bool = False, bin_width: float = 1.0) -> DataFrame:
    """Split-chain R-hat per parameter.

    With `rank_normalised`, the larger of the values on rank-normalised draws and on rank-normalised
    distances from the median.
    """
    split = _halves(draws)
    if not rank_normalised:
        parts = split.groupBy(*CHAIN, "half").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
        return _rhat(parts, "r_hat")
    bulk = _rhat(_normalised(split, bin_width), "_bulk")
    middle = quantiles(draws, ["param"], "x", [0.5], ["_median"])
    folded = split.join(middle, "param").withColumn("x", F.abs(F.col("x") - F.col("_median"))).drop("_median")
    tail = _rhat(_normalised(folded, bin_width), "_tail")
    return bulk.join(tail, "param").select("param", F.greatest("_bulk", "_tail").alias("r_hat"))


def _normalised(split: DataFrame, bin_width: float) -> DataFrame:
    """Normal scores of the average rank, summarised per (param, chain, half). Equal values are counted first."""
    counted = split.groupBy(*CHAIN, "half", "x").agg(F.count(F.lit(1)).alias("_n"))
    values = counted.groupBy("param", "x").agg(F.sum("_n").alias("_ties"))
    track = Track(["param"], "x", cell=F.floor(F.col("x") / bin_width))
    ranked = running(values, track, sum_before={"_below": F.col("_ties")})
    total = values.groupBy("param").agg(F.sum("_ties").alias("_total"))
    rank = F.coalesce("_below", F.lit(0)) + (F.col("_ties") + 1) / 2
    scores = ranked.join(total, "param").select(
        "param", "x", normal_quantile((rank - 0.375) / (F.col("_total") + 0.25)).alias("_z")
    )
    n = F.sum("_n")
    mean = F.sum(F.col("_n") * F.col("_z")) / n
    square = F.sum(F.col("_n") * F.col("_z") * F.col("_z"))
    return counted.join(scores, ["param", "x"]).groupBy(*CHAIN, "half").agg(
        n.alias("n"), mean.alias("mean"), ((square - n * mean * mean) / (n - 1)).alias("var")
    )


def draw_summary(draws: DataFrame, batches: int = 10) -> DataFrame:
    """Mean, sample deviation and batch-means error of the mean per parameter.

    A batch is one of `batches` equal stretches of a chain.
    """
    length = small_side(draws.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("_length")))
    batch = F.floor((F.col("draw") - 1) * batches / F.col("_length"))
    parts = draws.join(length, CHAIN).withColumn("_batch", batch).groupBy(*CHAIN, "_batch").agg(F.avg("x").alias("_m"))
    error = parts.groupBy("param").agg((F.stddev_samp("_m") / F.sqrt(F.count(F.lit(1)))).alias("mcse_mean"))
    totals = draws.groupBy("param").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return totals.join(error, "param")


def shortest_interval(draws: DataFrame, mass: float = 0.94, bin_width: float = 1.0) -> DataFrame:
    """Shortest interval holding `mass` of the draws per parameter.

    Draws are ranked by value through cells of width `bin_width`; each rank i is then matched with
    rank i + floor(mass n) by an equi-join.
    """
    track = Track(["param"], "x", ("chain", "draw"), cell=F.floor(F.col("x") / bin_width))
    ranked = running(draws.select(*CHAIN, "draw", "x"), track, position="_pos").select("param", "_pos", "x")
    total = small_side(draws.groupBy("param").agg(F.count(F.lit(1)).alias("_total")))
    low = ranked.join(total, "param").withColumn("_to", F.col("_pos") + F.floor(F.lit(float(mass)) * F.col("_total")))
    high = ranked.select("param", F.col("_pos").alias("_to"), F.col("x").alias("_high"))
    pairs = low.join(high, ["param", "_to"])
    best = F.min(F.struct((F.col("_high") - F.col("x")).alias("width"), F.col("_pos"), F.col("x").alias("low"), F.col("_high").alias("high")))
    return pairs.groupBy("param").agg(best.alias("_b")).select("param", F.col("_b.low").alias("hdi_low"), F.col("_b.high").alias("hdi_high"))


def _autocovariance(draws: DataFrame, lags: int) -> DataFrame:
    """Per (param, chain): length, mean and autocovariances at lags 0..lags, products taken inside blocks."""
    mean = small_side(draws.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_mean")))
    centred = draws.join(mean, CHAIN).select(*CHAIN, "draw", "_n", "_mean", (F.col("x") - F.col("_mean")).alias("_d"))
    products = looking_back(
        centred, CHAIN, "draw", -max(lags, 1),
        lambda w, _: {f"_p{k}": F.col("_d") * (F.col("_d") if k == 0 else F.lead("_d", k).over(w)) for k in range(lags + 1)},
    )
    sums = [(F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) / F.max("_n")).alias(f"_c{k}") for k in range(lags + 1)]
    return products.groupBy(*CHAIN).agg(F.max("_n").alias("n"), F.max("_mean").alias("mean"), *sums)


def effective_sample_size(draws: DataFrame, start_lags: int = 31) -> DataFrame:
    """Effective sample size per parameter (chains pooled, pairs of autocorrelations, monotone).

    Lags are taken until the first pair of autocorrelations that is not positive. Parameters still
    positive at the last lag are taken again with twice as many lags, so none is cut short.
    """
    done: DataFrame | None = None
    todo, lags = draws, start_lags | 1
    while True:
        part = settle(_ess(todo, lags))
        closed = part.where(F.col("closed")).select("param", "ess", "n_draws")
        done = closed if done is None else done.unionByName(closed)
        still = part.where(~F.col("closed")).select("param")
        if still.isEmpty():
            return done
        todo, lags = draws.join(still, "param", "left_semi"), 2 * lags + 1


def _ess(draws: DataFrame, lags: int) -> DataFrame:
    chains = _autocovariance(draws, lags)
    n = F.avg("n")
    agg = chains.groupBy("param").agg(
        n.alias("_n"), F.sum("n").alias("n_draws"), F.min("n").alias("_shortest"), F.max("n").alias("_longest"),
        F.avg(F.col("_c0") * F.col("n") / (F.col("n") - 1)).alias("_w"), F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("_b"),
        *[F.avg(f"_c{k}").alias(f"_c{k}") for k in range(lags + 1)],
    )
    plus = F.col("_w") * (F.col("_n") - 1) / F.col("_n") + F.col("_b")
    rho = [F.lit(1.0)] + [1 - (F.col("_w") - F.col(f"_c{k}")) / F.col("_plus") for k in range(1, lags + 1)]
    # A pair counts only while both of its lags exist in the longest chain.
    pairs = F.array(*[F.when(F.col("_longest") > k + 1, rho[k] + rho[k + 1]) for k in range(0, lags, 2)])
    start = F.struct(F.lit(0.0).alias("total"), F.lit(float("inf")).alias("last"), F.lit(True).alias("open"))

    def add(s: Column, p: Column) -> Column:
        keep = s["open"] & F.coalesce(p > 0, F.lit(False))
        level = F.least(s["last"], p)
        return F.struct(
            F.when(keep, s["total"] + level).otherwise(s["total"]).alias("total"),
            F.when(keep, level).otherwise(s["last"]).alias("last"), keep.alias("open"),
        )

    folded = agg.withColumn("_plus", plus).withColumn("_f", F.aggregate(pairs, start, add))
    tau = F.greatest(2 * F.col("_f.total") - 1, 1 / F.log10(F.col("n_draws").cast("double")))
    ended = ~F.col("_f.open") | (F.col("_longest") <= lags + 1)
    return folded.select("param", "n_draws", (F.col("n_draws") / tau).alias("ess"), ended.alias("closed"))


def worst_rhat(summary: DataFrame, k: int = 20, digits: int = 9) -> DataFrame:
    """The `k` parameters with the largest R-hat, name as tiebreak."""
    return summary.orderBy(F.desc(F.round("r_hat", digits)), "param").limit(k)


def rhat_by_type(summary: DataFrame, types: Sequence[str], threshold: float = 1.01) -> DataFrame:
    """Per parameter type (a text the name contains): how many exceed the threshold."""
    kind = F.explode(F.array(*[F.lit(t) for t in types]))
    return (
        summary.withColumn("param_type", kind)
        .where(F.contains(F.col("param"), F.col("param_type")))
        .groupBy("param_type")
        .agg(F.count_if(F.col("r_hat") > threshold).alias("n_bad"), F.count(F.lit(1)).alias("n_total"))
    )


def rhat_counts(summary: DataFrame, thresholds: Sequence[float] = (1.01, 1.05)) -> DataFrame:
    counts = [F.count_if(F.col("r_hat") > t).alias(f"above_{str(t).replace('.', '_')}") for t in thresholds]
    return summary.agg(*counts, F.count(F.lit(1)).alias("n_params"))


def key_parameters(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    return summary.where(F.col("param").isin(*names))


def sampler_stats(stats: DataFrame) -> DataFrame:
    """Per chain: mean acceptance, step size of the last draw, divergences."""
    return stats.groupBy("chain").agg(
        F.avg("acceptance_rate").alias("acceptance_rate"), F.max_by("step_size", "draw").alias("last_step_size"),
        F.sum(F.col("diverging").cast("int")).cast("long").alias("divergences"), F.count(F.lit(1)).alias("n_draws"),
    )
