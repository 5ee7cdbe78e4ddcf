"""As-of join of facts to interval-valid ratings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators.cells import Track, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str = "team",
    right_by: str | None = None,
    left_ts: str = "datetime",
    right_ts: str = "valid_from",
    values: Sequence[str] = ("rating",),
    valid_to: str | None = None,
    prefix: str | None = None,
    unit: str = "day",
) -> DataFrame:
    """Left-outer backward join: each left row gets the latest right row with `right_ts <= left_ts`.

    Both sides are stacked in time order, ratings before facts at equal times, and the last rating is
    carried forward: one shuffle, no row blow-up, and a hot key is split by `unit`. Among ratings of
    the same moment the largest values win, so the result does not depend on input order. With
    `valid_to` a rating past its end gives NULL.
    """
    right_by = right_by or by
    carried = [right_ts, *[v for v in values if v != right_ts]]
    if valid_to and valid_to not in carried:
        carried.append(valid_to)
    payload = F.struct(*[F.col(c) for c in left.columns])
    facts = left.select(
        F.col(by).alias("_key"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), payload.alias("_left")
    )
    rates = right.where(F.col(values[0]).isNotNull()).select(
        F.col(right_by).alias("_key"),
        F.col(right_ts).alias("_ts"),
        F.lit(0).alias("_side"),
        F.struct(*carried).alias("_right"),
    )
    stacked = facts.unionByName(rates, allowMissingColumns=True)
    track = Track(["_key"], "_ts", ("_side", "_right"), unit)
    joined = running(stacked, track, last_until={"_match": F.col("_right")}).where(F.col("_side") == 1)
    columns = []
    for name in [*values, right_ts]:
        value = F.col(f"_match.{name}")
        if valid_to:
            value = F.when(F.col("_ts") <= F.col(f"_match.{valid_to}"), value)
        columns.append(value.alias(f"{prefix}_{name}" if prefix else name))
    return joined.select("_left.*", *columns)


def asof_ratings(
    rows: DataFrame,
    ratings: DataFrame,
    *,
    team: str = "team",
    prefix: str | None = None,
    mapping: Mapping[str, str] | None = None,
    check_end: bool = False,
) -> DataFrame:
    """Rating history (`Club, Elo, From, To`) onto team rows: names normalised, match day inclusive."""
    history = ratings.where(F.col("Elo").isNotNull()).select(
        S.club_key(F.col("Club"), {}).alias("_club"), "Elo", F.col("From").cast("timestamp").alias("From"),
        F.col("To").cast("timestamp").alias("To"),
    )
    day = rows.withColumns({"datetime": F.date_trunc("day", "datetime"), team: S.club_key(F.col(team), mapping)})
    return asof_join(
        day, history, by=team, right_by="_club", right_ts="From", values=["Elo", "To"],
        valid_to="To" if check_end else None, prefix=prefix,
    )


def asof_both_sides(rows: DataFrame, ratings: DataFrame, sides: Mapping[str, str], **options) -> DataFrame:
    """One pass per side: `sides` maps the key column to the prefix of its rating columns."""
    out = rows
    for by, prefix in sides.items():
        out = asof_join(out, ratings, by=by, right_by=options.get("right_by", "team"), prefix=prefix,
                        **{k: v for k, v in options.items() if k != "right_by"})
    return out


def unmatched(joined: DataFrame, by: str = "team", value: str = "rating") -> DataFrame:
    """How many rows of each key found no rating, for keys where any did not."""
    return (
        joined.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_unmatched"))
        .where(F.col("n_unmatched") > 0)
    )


def teams_without_ratings(rows: DataFrame, ratings: DataFrame, by: str = "team", right_by: str = "team") -> DataFrame:
    """Keys that have no rating at all; both sides are reduced to their keys first."""
    known = ratings.select(F.col(right_by).alias(by)).distinct()
    return rows.select(by).distinct().join(known, by, "left_anti")
