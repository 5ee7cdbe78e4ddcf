"""The long draws table: one row per (chain, draw, t, team) with attack, defence and home advantage."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as S
from touchline.operators.cells import BLOCK_ROWS, looking_back, quantiles

SAMPLE = ("chain", "draw")


def explode_draws(df: DataFrame, arrays: Mapping[str, str], keep: Sequence[str] = SAMPLE, index: str = "team_id") -> DataFrame:
    """Draws delivered as one array per sample (indexed by team) -> long rows; `arrays` maps column -> output."""
    zipped = F.arrays_zip(*arrays)
    return df.select(*keep, F.posexplode(zipped).alias(index, "_v")).select(
        *keep, index, *[F.col(f"_v.{c}").cast("double").alias(out) for c, out in arrays.items()]
    )


def posterior_mean(draws: DataFrame, keys: Sequence[str] = ("t", "team_id"), values: Sequence[str] = ("attack", "defence", "home_adv")) -> DataFrame:
    return draws.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def team_strengths(draws: DataFrame) -> DataFrame:
    """Mean, p5 and p95 per (param, team, t); home advantage has no time and is given t = -1."""
    entries = F.array(
        F.struct(F.lit("attack").alias("param"), F.col("t"), F.col("attack").alias("value")),
        F.struct(F.lit("defence").alias("param"), F.col("t"), F.col("defence").alias("value")),
    )
    timed = draws.select("team_id", F.inline(entries))
    if "home_adv" in draws.columns:
        # One home advantage per sample and team, repeated on each of its time steps.
        fixed = draws.groupBy(*SAMPLE, "team_id").agg(F.max("home_adv").alias("value"))
        timed = timed.unionByName(fixed.select("team_id", F.lit("home_adv").alias("param"), F.lit(-1).alias("t"), "value"))
    return summarise(timed, ["param", "team_id", "t"])


def summarise(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean and exact p5 and p95 of `value` per group, without gathering a group in one task."""
    return quantiles(long, group, "value", [0.05, 0.95], ["p5", "p95"], [F.avg("value").alias("mean")])


def nest_strengths(summary: DataFrame, by: Sequence[str] = ("team_id",), digits: int = 4) -> DataFrame:
    """Store shape: per team the attack and defence paths as arrays ordered by t, and one home summary."""
    point = F.struct("t", *[F.bround(c, digits).alias(c) for c in ("mean", "p5", "p95")])
    still = F.struct(*[F.bround(c, digits).alias(c) for c in ("mean", "p5", "p95")])

    def path(param: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("param") == param, point)))

    return summary.groupBy(*by).agg(
        path("attack").alias("attack"), path("defence").alias("defence"),
        F.first(F.when(F.col("param") == "home_adv", still), ignorenulls=True).alias("home_adv"),
    )


def ar1_path(
    noise: DataFrame, *, rho: float, sigma: float, init_scale: float = 0.2, z: str = "z", entity: Sequence[str] = (*SAMPLE, "team_id"),
    t: str = "t", name: str = "x",
) -> DataFrame:
    """x[0] = init_scale z[0], x[t] = rho x[t-1] + sigma z[t], per entity over consecutive t from 0.

    Closed form: a decayed running sum inside blocks of time steps, reaching back to where the
    weight is below double precision.
    """
    shock = F.when(F.col(t) == 0, F.lit(float(init_scale)) * F.col(z)).otherwise(F.lit(float(sigma)) * F.col(z))
    if rho <= 0:
        return noise.withColumn(name, shock)
    if rho >= 1:
        raise ValueError("rho must be below 1")
    near = math.ceil(53 * math.log(2) / -math.log(rho))
    size = max(near, min(BLOCK_ROWS, int(600 / -math.log(rho)) - near))

    def path(w, offset) -> dict[str, Column]:
        growth = F.pow(F.lit(1.0 / rho), offset.cast("double"))
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return {name: F.sum(F.col("_shock") * growth).over(upto) / growth}

    rows = noise.withColumns({"_shock": shock, "_step": F.col(t) + 1})
    return looking_back(rows, entity, "_step", near, path, size).drop("_shock", "_step")


def centre_over_teams(draws: DataFrame, columns: Sequence[str] = ("attack", "defence"), by: Sequence[str] = (*SAMPLE, "t")) -> DataFrame:
    """Subtract the mean over teams at each (sample, t); a window holds one row per team."""
    w = Window.partitionBy(*by)
    return draws.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def drift_penalty(draws: DataFrame, sd: float = 1.0, columns: Sequence[str] = ("attack", "defence")) -> DataFrame:
    """Per sample: normal log density of the mean over teams at each t, summed over t."""
    means = draws.groupBy(*SAMPLE, "t").agg(*[F.avg(c).alias(c) for c in columns])
    constant = math.log(sd) + 0.5 * math.log(2 * math.pi)
    terms = [F.sum(-F.pow(F.col(c) / sd, F.lit(2.0)) / 2 - constant).alias(f"penalty_{c}") for c in columns]
    return means.groupBy(*SAMPLE).agg(*terms)


#: Rows a task looks through at a time for those it may keep, and most that it keeps before it passes them on.
ROWS_AT_ONCE, ROWS_KEPT = 131_072, 1_000_000


def _least(batches: Iterator[pa.RecordBatch], n: int, by: Sequence[str], order: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The first `n` rows of each group among those of a task, or a few more."""
    kept: list[pa.RecordBatch] = []

    def cut() -> pa.Table:
        table = pa.Table.from_batches(kept)
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        keys = pa.table([*table.select(list(by)).columns, pa.array(np.arange(len(table)))], names=[*by, "_row"])
        rows = keys.group_by(list(by), use_threads=False).aggregate([("_row", "list")])["_row_list"].combine_chunks()
        sizes = rows.value_lengths().to_numpy()
        rank = np.arange(len(table)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return table.take(rows.flatten().filter(pa.array(rank < n)))

    size, left = 0, 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= left + max(ROWS_AT_ONCE, left):
            kept = cut().to_batches()
            size = left = sum(b.num_rows for b in kept)
            if size > ROWS_KEPT:
                yield from kept
                kept, size, left = [], 0, 0
    if size:
        yield from cut().to_batches()


def subsample(draws: DataFrame, n: int, *, by: Sequence[str] = ("match_id",), seed: int = 42) -> DataFrame:
    """`n` samples per group without replacement, the same ones on every run.

    Ranked by a hash of the row's identity. Each task first drops, as it reads, what cannot be among the first `n` of its own rows, so
    only about `n` rows per group and task are sorted and shuffled.
    """
    key = by[0]
    mixed = S.mixed_uniform(seed, F.col(key), F.col("chain"), F.col("draw"))
    rows = draws.withColumn("_u", mixed)
    keys, order = list(by), ["_u", *SAMPLE]
    rows = rows.mapInArrow(lambda batches: _least(batches, n, keys, order), rows.schema)
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_u", "_rank")
