"""Scalar column expressions; all stay inside code generation except long factorials."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Club spellings used by the rating source, keyed by the match feed's spelling.
CLUB_NAMES = {
    "Manchester City": "ManCity",
    "Manchester United": "ManUnited",
    "Newcastle United": "Newcastle",
    "Nottingham Forest": "Forest",
    "Queens Park Rangers": "QPR",
    "West Bromwich Albion": "WestBrom",
    "Wolverhampton Wanderers": "Wolves",
}
# Bounds of the predicted goal rate, of the log rate and of the opponent factor.
RATE_BOUNDS = (0.01, 10.0)
LOG_RATE_BOUNDS = (-5.0, 5.0)
OPPONENT_FACTOR_BOUNDS = (0.5, 1.5)
XG_OFFSET = 0.01


def soft_clip(x: Column, limit: float) -> Column:
    """Smooth clip to (-limit, limit), used on log rates while fitting."""
    return F.lit(float(limit)) * F.tanh(x / F.lit(float(limit)))


def hard_clip(x: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def log_factorial(k: Column) -> Column:
    """ln k!: the exact factorial up to 20, beyond that a sum of logarithms."""
    beyond = F.aggregate(
        F.sequence(F.lit(21).cast("long"), F.greatest(k.cast("long"), F.lit(21).cast("long"))),
        F.lit(math.log(math.factorial(20))),
        lambda total, i: total + F.log(i.cast("double")),
    )
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(beyond)


def poisson_logpmf(k: Column, rate: Column) -> Column:
    """ln P(K = k) for a Poisson rate; rate 0 puts all mass on k = 0."""
    return F.when(
        rate > 0, k.cast("double") * F.log(F.when(rate > 0, rate)) - rate - log_factorial(k)
    ).when(rate == 0, F.when(k == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))))


def poisson_pmf(k: int, rate: Column) -> Column:
    """P(K = k) for a constant k."""
    return F.exp(F.lit(float(k)) * F.log(rate) - rate - F.lit(math.lgamma(k + 1)))


def log_xg(x: Column) -> Column:
    return F.log(x + F.lit(XG_OFFSET))


def score_text(home: Column, away: Column) -> Column:
    return F.concat_ws("-", home.cast("string"), away.cast("string"))


def club_key(name: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """Rating-source spelling: the mapping if the name is in it, else the name without spaces."""
    mapping = CLUB_NAMES if mapping is None else mapping
    plain = F.replace(name, F.lit(" "), F.lit(""))
    if not mapping:
        return plain
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return F.coalesce(F.try_element_at(table, name), plain)


def round_week(ts: Column) -> Column:
    """Monday of the week a match counts for; a Monday match belongs to the week before."""
    return F.date_trunc("week", ts - F.expr("INTERVAL 1 DAY"))


def pair_key(ts: Column, a: Column, b: Column) -> Column:
    """Same text for both perspectives of a match: time and the two names in order."""
    names = F.array_sort(F.array(a.cast("string"), b.cast("string")))
    return F.concat_ws("_", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.array_join(names, "_"))


def mixed_uniform(seed: int, *keys: Column) -> Column:
    """Reproducible uniform in [0, 1) from row keys: 52 bits of an MD5 digest, the same in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: float, tail: float = 1e-9) -> list[float]:
    """Cumulative probabilities P(K <= 0), P(K <= 1), ... until the remaining tail is below `tail`."""
    steps, term, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        steps.append(total)
        if 1.0 - total < tail:
            return steps
        k += 1
        term *= rate / k


def poisson_one(u: Column) -> Column:
    """Poisson(1) count for a uniform: how many cumulative probabilities lie at or below it."""
    counts = [(u >= F.lit(step)).cast("int") for step in poisson_steps(1.0)]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total
