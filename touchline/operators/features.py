"""Past-only features of an entity's ordered history: lags, weighted means, sums, form, streaks, rest.

Every feature of a row uses earlier rows of the same entity only. Histories are split with
`cells.running` and `cells.looking_back`, so no entity has to fit in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import scalars as S
from touchline.operators.cells import BLOCK_ROWS, CHUNK, OWN, Track, looking_back, measured, overlapping, quantiles, running
from touchline.operators.reshape import require

POSITION = "_pos"
LAGGED = ("goals", "xG", "goals_against", "xGA", "win", "loss", "draw", "is_home")
METRICS = ("goals", "xG", "goals_against", "xGA")
#: A team of up to this many rows may be windowed in one task: with all features a row takes up to 4 kB of its memory.
TEAM_ROWS = 800_000
#: Rows of a chunk of a larger team.
CHUNK_ROWS = 65_536
# Window columns of a block, from its ordered window and the row's offset in it.
BlockColumns = Callable[[WindowSpec, Column], dict[str, Column]]


def positioned(df: DataFrame, track: Track) -> DataFrame:
    return df if POSITION in df.columns else running(df, track, position=POSITION)


def lag_columns(columns: Sequence[str], lags: Sequence[int]) -> BlockColumns:
    return lambda w, _: {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in lags for c in columns}


def lag_features(
    df: DataFrame, track: Track, columns: Sequence[str] = LAGGED, lags: Sequence[int] = (1, 3, 5)
) -> DataFrame:
    """`<column>_lag_<k>` for every column that is present."""
    had_position = POSITION in df.columns
    present = [c for c in columns if c in df.columns]
    out = looking_back(positioned(df, track), track.entity, POSITION, max(lags), lag_columns(present, lags))
    return out if had_position else out.drop(POSITION)


def ewm_reach(span: float) -> tuple[float, int, int]:
    """Decay per row, rows until a weight is below double precision, and rows a block may have.

    Growing weights must not overflow within a block and its copied rows.
    """
    decay = 1.0 - 2.0 / (span + 1.0)
    rate = -math.log(decay)
    near = math.ceil(53 * math.log(2) / rate)
    return decay, near, max(2 * near, min(BLOCK_ROWS, int(600 / rate) - 2 * near))


def ewm_columns(columns: Mapping[str, str], span: float) -> BlockColumns:
    """Ratio of two prefix sums with growing weights; NULL where the last value lies too far back."""
    decay, near, _ = ewm_reach(span)

    def build(w: WindowSpec, offset: Column) -> dict[str, Column]:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        growth = F.pow(F.lit(1.0 / decay), offset.cast("double"))
        out = {}
        for name, c in columns.items():
            x = F.col(c).cast("double")
            top = F.sum(x * growth).over(before)
            bottom = F.sum(F.when(x.isNotNull(), growth)).over(before)
            latest = F.max(F.when(x.isNotNull(), offset)).over(before)
            out[name] = F.when(latest >= offset - near, top / bottom)
        return out

    return build


def ewm_features(df: DataFrame, track: Track, columns: Mapping[str, str], span: float, long_gaps: bool = True) -> DataFrame:
    """Exponentially weighted mean of earlier rows; `columns` maps output name -> input column.

    Weights fall by 1 - 2/(span + 1) per row, rows without a value still age the others. Copied rows
    reach twice as far back as a weight matters. When no value lies within that, the mean has not
    changed since, and `long_gaps` carries it over (one more pass, only needed with NULL inputs).
    """
    if span <= 1:
        return running(df, track, last_before={out: F.col(c) for out, c in columns.items()})
    _, near, rows_per_block = ewm_reach(span)
    had_position = POSITION in df.columns
    out = looking_back(positioned(df, track), track.entity, POSITION, 2 * near, ewm_columns(columns, span), rows_per_block)
    if long_gaps:
        out = running(out, track, last_until={name: F.col(name) for name in columns})
    return out if had_position else out.drop(POSITION)


def cumsum_features(df: DataFrame, track: Track, columns: Mapping[str, str]) -> DataFrame:
    """Sum over all earlier rows, NULL where the previous row has no value."""
    out = running(
        df,
        track,
        sum_before={name: F.col(c) for name, c in columns.items()},
        last_before={"_previous": F.struct(*dict.fromkeys(columns.values()))},
    )
    masked = {n: F.when(F.col(f"_previous.{c}").isNotNull(), F.col(n)) for n, c in columns.items()}
    return out.withColumns(masked).drop("_previous")


def efficiency_ratios(df: DataFrame) -> DataFrame:
    """Goals per expected goal and one minus conceded per expected; NULL on division by zero."""
    out: dict[str, Column] = {}
    if {"rolling_goals_avg", "rolling_xG_avg"} <= set(df.columns):
        out["goal_efficiency"] = F.try_divide("rolling_goals_avg", "rolling_xG_avg")
    if {"rolling_goals_against_avg", "rolling_xGA_avg"} <= set(df.columns):
        out["defensive_efficiency"] = 1 - F.try_divide("rolling_goals_against_avg", "rolling_xGA_avg")
    return df.withColumns({k: S.finite(v) for k, v in out.items()}) if out else df


def venue_win_rates(df: DataFrame, track: Track, span: float = 5, win: str = "win", is_home: str = "is_home") -> DataFrame:
    """Weighted win rate over earlier home rows (on home rows) and earlier away rows (on away rows).

    A position column already on the rows must count within the venue.
    """
    by_venue = replace(track, entity=[*track.entity, is_home])
    out = ewm_features(df, by_venue, {"_rate": win}, span)
    return out.withColumns(
        {
            "home_win_rate": F.when(F.col(is_home) == 1, F.col("_rate")),
            "away_win_rate": F.when(F.col(is_home) == 0, F.col("_rate")),
        }
    ).drop("_rate")


def form_columns(games: int, name: str = "recent_form") -> BlockColumns:
    points = F.col("win") * 3 + F.col("draw")
    return lambda w, _: {name: F.sum(points).over(w.rowsBetween(-games, -1))}


def recent_form(df: DataFrame, track: Track, games: int = 5, name: str = "recent_form") -> DataFrame:
    """Three per win and one per draw over the previous `games` rows; NULL on the first row."""
    had_position = POSITION in df.columns
    out = looking_back(positioned(df, track), track.entity, POSITION, games, form_columns(games, name))
    return out if had_position else out.drop(POSITION)


def streaks(
    df: DataFrame, track: Track, conditions: Mapping[str, Column], unknown_counts: bool = False
) -> DataFrame:
    """Length of the unbroken run just before each row, per output name -> condition.

    With `unknown_counts` the unknown row before an entity's first one extends the run by one.
    """
    position = POSITION if POSITION in df.columns else "_streak_pos"
    out = running(df, track, position=None if position in df.columns else position, run_before=conditions)
    if unknown_counts:
        never_broken = {n: F.when(F.col(n) == F.col(position) - 1, F.col(n) + 1).otherwise(F.col(n)) for n in conditions}
        out = out.withColumns(never_broken)
    return out.drop("_streak_pos")


def match_streaks(df: DataFrame, track: Track, unknown_counts: bool = False) -> DataFrame:
    """Win, loss and unbeaten streaks before each match; the unbeaten one always starts at 0."""
    out = streaks(df, track, {"win_streak": F.col("win") != 0, "loss_streak": F.col("loss") != 0}, unknown_counts)
    return streaks(out, track, {"unbeaten_streak": (F.col("win") + F.col("draw")) > 0})


def rest_days(df: DataFrame, track: Track, name: str = "days_since_last_match") -> DataFrame:
    """Whole days of elapsed time since the previous row."""
    out = running(df, track, last_before={"_previous": F.col(track.ts)})
    gap = F.unix_micros(track.ts) - F.unix_micros("_previous")
    return out.withColumn(name, F.floor(gap / F.lit(86_400_000_000)).cast("int")).drop("_previous")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def fill_values(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """One row holding the table-wide mean or median of each column."""
    if method == "mean":
        return df.agg(*[F.avg(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.inline(pairs))
    medians = quantiles(long, ["name"], "x", [0.5], ["median"])
    return medians.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


def fill(df: DataFrame, track: Track, columns: Sequence[str], method: str = "ffill") -> DataFrame:
    """Replace missing values.

    ffill carries the entity's last value forward. bfill takes its next one and so leaks the future;
    mean and median use the whole table, the future included. none leaves the NULLs.
    """
    if method == "none" or not columns:
        return df
    if method == "ffill":
        return running(df, track, last_until={c: F.col(c) for c in columns})
    if method == "bfill":
        return running(df, track, next_from={c: F.col(c) for c in columns})
    if method not in ("mean", "median"):
        raise ValueError(f"unknown fill method {method!r}")
    # A single aggregate row, so the product only widens each row.
    values = fill_values(df, columns, method).withColumnsRenamed({c: f"_fill_{c}" for c in columns})
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(values)).withColumns(filled).drop(*[f"_fill_{c}" for c in columns])


def validate_features(df: DataFrame) -> None:
    require(df, ["team", "datetime"])
    if not set(METRICS) & set(df.columns):
        raise ValueError(f"nothing to derive features from: give at least one of {list(METRICS)}")


def _bounded_features(
    df: DataFrame, track: Track, lags: Sequence[int], span: int, means: Mapping[str, str], form: bool
) -> DataFrame:
    """Lags, weighted means and form from one pass over the blocks."""
    parts = [lag_columns([c for c in LAGGED if c in df.columns], lags)]
    size = BLOCK_ROWS
    if span > 1:
        _, _, size = ewm_reach(span)
        parts.append(ewm_columns(means, span))
    if form:
        parts.append(form_columns(span))

    def columns(w: WindowSpec, offset: Column) -> dict[str, Column]:
        return {name: column for part in parts for name, column in part(w, offset).items()}

    return looking_back(df, track.entity, POSITION, _reach(lags, span), columns, size)


def _reach(lags: Sequence[int], span: int) -> int:
    """How many rows back lags, form and weighted means look."""
    return max([*lags, span, 2 * ewm_reach(span)[1] if span > 1 else 1])


def _venue_position() -> Column:
    """Position of a row within its venue, from the rows before at either; rows without a position have none there."""
    before = F.when(F.col("is_home") == 1, F.col("_homes")).otherwise(F.col("_aways"))
    return F.when(F.col(POSITION).isNotNull(), F.coalesce(before, F.lit(0)) + 1)


def _split_steps(
    df: DataFrame, track: Track, lags: Sequence[int], span: int, means: Mapping[str, str], form: bool, venues: Mapping[str, Column],
    running_values: Mapping[str, Mapping[str, Column]], chunk_rows: int,
) -> DataFrame:
    """All of a table's features but ratios, by `CHUNK`: one shuffle of the rows, what came before a chunk is joined on.

    Whatever looks a bounded number of rows back is found inside chunks with the copies they begin with; then copies go, and sums,
    streaks and last values are carried from chunk to chunk.
    """
    rows = overlapping(df, track, _reach(lags, span), chunk_rows, ["is_home"] if venues else [])
    inside = replace(track, entity=[*track.entity, CHUNK], plain=True)
    rows = running(rows, inside, position=POSITION, sum_before={"_homes": F.col("is_home"), "_aways": 1 - F.col("is_home")} if venues else {})
    rows = _bounded_features(rows, inside, lags, span, means, form)
    if venues:
        rows = rows.withColumn(POSITION, _venue_position()).drop("_homes", "_aways")
        if span > 1:
            rates = ewm_columns({"_rate": "win"}, span)
            rows = looking_back(rows, [*inside.entity, "is_home"], POSITION, _reach([], span), rates, ewm_reach(span)[2])
    rows = rows.where(OWN).drop(OWN, POSITION)
    # weighted means are carried over rows without a value, at each venue apart
    last = {name: F.col(name if span > 1 else c) for name, c in means.items()}
    last |= {name: F.when(at, F.col("_rate" if span > 1 else "win")) for name, at in venues.items()}
    values = {k: dict(v) for k, v in running_values.items()}
    carry = "last_until" if span > 1 else "last_before"
    values[carry] = values.get(carry, {}) | last
    rows = running(rows, replace(track, cell=F.col(CHUNK), plain=False), **values)
    return rows.withColumns({name: F.when(at, F.col(name)) for name, at in venues.items()}).drop("_rate")


def feature_columns(
    columns: Sequence[str], *, lags: Sequence[int] = (1, 3, 5), add_win_rates: bool = True, add_form_streaks: bool = True,
    add_rest_days: bool = True, **_,
) -> list[str]:
    """Names of the columns `feature_table` returns for rows with `columns`, in their order."""
    has = set(columns)
    metrics = [c for c in METRICS if c in has]
    flags = {"win", "draw", "loss"} <= has and add_form_streaks
    found = [f"cumsum_{c}" for c in metrics]
    found += ["win_streak", "loss_streak", "unbeaten_streak"] if flags else []
    found += ["days_since_last_match"] if add_rest_days else []
    found += [f"{c}_lag_{k}" for k in lags for c in LAGGED if c in has]
    found += [f"rolling_{c}_avg" for c in metrics]
    found += ["recent_form"] if flags else []
    found += ["goal_efficiency"] if {"goals", "xG"} <= has else []
    found += ["defensive_efficiency"] if {"goals_against", "xGA"} <= has else []
    found += ["home_win_rate", "away_win_rate"] if {"win", "is_home"} <= has and add_win_rates else []
    return [*[c for c in columns if c not in found], *found]


def feature_table(
    df: DataFrame,
    *,
    tiebreak: Sequence[str] = (),
    lags: Sequence[int] = (1, 3, 5),
    rolling_window: int = 5,
    add_win_rates: bool = True,
    add_form_streaks: bool = True,
    add_rest_days: bool = True,
    fill_method: str = "ffill",
    unit: str = "day",
    max_entity_rows: int = TEAM_ROWS,
) -> DataFrame:
    """All features of team rows in one plan; steps whose inputs are absent are left out.

    Team sizes are counted first: if none exceeds `max_entity_rows`, every step runs on a single shuffle by team, otherwise on a
    single shuffle by team and chunk of its history. The position is computed once together with sums, streaks and rest; lags, means
    and form then share one block pass.
    """
    validate_features(df)
    original = df.columns
    has = set(original)
    track = measured(df, Track(["team"], "datetime", tuple(tiebreak), unit), max_entity_rows)
    metrics = [c for c in METRICS if c in has]
    flags = {"win", "draw", "loss"} <= has and add_form_streaks
    venues = {"win", "is_home"} <= has and add_win_rates

    runs = {"win_streak": F.col("win") != 0, "loss_streak": F.col("loss") != 0} if flags else {}
    if flags:
        runs["unbeaten_streak"] = (F.col("win") + F.col("draw")) > 0
    means = {f"rolling_{c}_avg": c for c in metrics}
    values = {
        "sum_before": {f"cumsum_{c}": F.col(c) for c in metrics},
        "last_before": {"_previous": F.struct(F.col("datetime").alias("_at"), *metrics)},
        "run_before": runs,
    }
    if track.plain:
        # Earlier rows at either venue: the row's position within its own venue follows from them.
        values["sum_before"] |= {"_homes": F.col("is_home"), "_aways": 1 - F.col("is_home")} if venues else {}
        out = running(df, track, position=POSITION, **values)
    else:
        at = {"home_win_rate": F.col("is_home") == 1, "away_win_rate": F.col("is_home") == 0} if venues else {}
        out = _split_steps(df, track, lags, rolling_window, means, flags, at, values, min(max_entity_rows, CHUNK_ROWS))
        track = replace(track, cell=F.col(CHUNK))
    derived = {f"cumsum_{c}": F.when(F.col(f"_previous.{c}").isNotNull(), F.col(f"cumsum_{c}")) for c in metrics}
    if add_rest_days:
        gap = F.unix_micros("datetime") - F.unix_micros("_previous._at")
        derived["days_since_last_match"] = F.floor(gap / F.lit(86_400_000_000)).cast("int")
    out = out.withColumns(derived).drop("_previous")
    if track.plain:
        out = _bounded_features(out, track, lags, rolling_window, means, flags)
        if rolling_window > 1:
            # where no value lies within reach the mean is still the one of the last row that had one
            out = running(out, track, last_until={name: F.col(name) for name in means})
        else:
            out = ewm_features(out, track, means, rolling_window)
        if venues:
            out = out.withColumn(POSITION, _venue_position()).drop("_homes", "_aways")
            out = venue_win_rates(out, track, rolling_window)
    out = efficiency_ratios(out)
    found = feature_columns(
        original, lags=lags, add_win_rates=add_win_rates, add_form_streaks=add_form_streaks, add_rest_days=add_rest_days
    )
    out = out.select(*found, *([] if track.plain else [CHUNK]))
    return fill(out, track, numeric_columns(out, skip=["team", CHUNK]), fill_method).select(*found)
