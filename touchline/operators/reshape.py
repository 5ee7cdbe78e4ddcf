"""From nested match records to one row per team and match."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators.cells import Track, running
from touchline.session import small_side

FEED_METRICS = {"goals": ("h_g", "a_g"), "xG": ("h_xG", "a_xG")}
FEED_AGAINST = {"goals": "goals_against", "xG": "xGA"}


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}")


def flatten_matches(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nested feed records -> flat match rows; missing scores become 0 and `is_played` 0.

    Parsing is tolerant (`try_` casts): a malformed number counts as missing.
    """
    require(raw, ["datetime", "h", "a", "goals", "xG"])

    def number(path: str, kind: str) -> Column:
        return F.coalesce(F.col(path).try_cast(kind), F.lit(0).cast(kind))

    return raw.select(
        *keep,
        F.try_to_timestamp(F.col("datetime").cast("string")).alias("datetime"),
        F.col("h.short_title").alias("h_short_title"),
        F.col("h.title").alias("h_title"),
        F.col("a.short_title").alias("a_short_title"),
        F.col("a.title").alias("a_title"),
        number("goals.h", "int").alias("h_g"),
        number("goals.a", "int").alias("a_g"),
        number("xG.h", "double").alias("h_xG"),
        number("xG.a", "double").alias("a_xG"),
        (F.col("goals.h").isNotNull() & F.col("goals.a").isNotNull()).cast("int").alias("is_played"),
    )


def to_team_rows(
    matches: DataFrame,
    *,
    home: str = "h_short_title",
    away: str = "a_short_title",
    metrics: Mapping[str, tuple[str, str]] = FEED_METRICS,
    against: Mapping[str, str] = FEED_AGAINST,
    names: tuple[str, str] | None = None,
    keep: Sequence[str] = ("datetime",),
) -> DataFrame:
    """Two rows per match, one per side, from a single scan.

    `metrics` maps a team metric to its (home, away) columns; `against` names the opponent's value.
    """
    require(matches, [home, away, *keep, *[c for pair in metrics.values() for c in pair]])

    def side(own: int) -> Column:
        other = 1 - own
        fields = [
            F.col((home, away)[own]).alias("team"),
            F.col((home, away)[other]).alias("opp_team"),
        ]
        if names:
            fields += [F.col(names[own]).alias("team_long"), F.col(names[other]).alias("opp_team_long")]
        for metric, pair in metrics.items():
            fields += [F.col(pair[own]).alias(metric), F.col(pair[other]).alias(against[metric])]
        fields.append(F.lit(1 - own).alias("is_home"))
        return F.struct(*fields)

    return matches.select(*keep, F.inline(F.array(side(0), side(1))))


def result_flags(rows: DataFrame, goals: str = "goals", against: str = "goals_against") -> DataFrame:
    """0/1 flags for the result and the goal difference."""
    require(rows, [goals, against])
    own, other = F.col(goals), F.col(against)
    return rows.withColumns(
        {
            "win": (own > other).cast("int"),
            "loss": (own < other).cast("int"),
            "draw": (own == other).cast("int"),
            "gd": own - other,
        }
    )


def team_matches(raw: DataFrame, keep: Sequence[str] = ("season",)) -> DataFrame:
    """Feed records -> team rows with result flags; `keep` carries partition columns through."""
    flat = flatten_matches(raw, keep)
    rows = to_team_rows(flat, names=("h_title", "a_title"), keep=["datetime", "is_played", *keep])
    return result_flags(rows)


def perspective_columns(
    rows: DataFrame, metrics: Mapping[str, str] | None = None, true_sides: bool = False
) -> DataFrame:
    """`<metric>_home` = own value and `<metric>_away` = opponent's value, on both kinds of row.

    With `true_sides` also `home_<metric>` / `away_<metric>`, the actual host's and visitor's values.
    """
    metrics = metrics or {"goals": "goals_against", "xG": "xGA"}
    out: dict[str, Column] = {}
    for own, other in metrics.items():
        out[f"{own}_home"], out[f"{own}_away"] = F.col(own), F.col(other)
        if true_sides:
            host = F.col("is_home") == 1
            out[f"home_{own}"] = F.when(host, F.col(own)).otherwise(F.col(other))
            out[f"away_{own}"] = F.when(host, F.col(other)).otherwise(F.col(own))
    return rows.withColumns(out)


def normalise_names(rows: DataFrame, column: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    return rows.withColumn(column, S.club_key(F.col(column), mapping))


def first_seen(rows: DataFrame, columns: Sequence[str] = ("team", "opp_team"), ts: str = "datetime", extra: Column | None = None) -> DataFrame:
    """Distinct names over several columns with the time each was first seen."""
    pairs = rows.select(F.col(ts).alias("_ts"), F.explode(F.array(*columns)).alias("team"))
    return pairs.groupBy("team").agg(F.min("_ts").alias("first_seen"))


def team_index(rows: DataFrame, columns: Sequence[str] = ("team", "opp_team"), ts: str = "datetime") -> DataFrame:
    """`team -> team_id`, 0-based in order of first appearance, name as tiebreak.

    Names are ranked within the day they first appear and offset by the days before, so the global
    rank needs no single sorted partition.
    """
    ranked = running(first_seen(rows, columns, ts), Track([], "first_seen", ("team",)), position="_rank")
    return ranked.select("team", "first_seen", (F.col("_rank") - 1).cast("int").alias("team_id"))


def add_team_ids(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """Look both sides up in the index."""
    index = small_side(teams.select("team", "team_id"))
    other = index.withColumnsRenamed({"team": "opp_team", "team_id": "opp_id"})
    return rows.join(index, "team", "left").join(other, "opp_team", "left")
