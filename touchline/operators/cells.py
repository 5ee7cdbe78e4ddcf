"""Per-entity ordered computation that does not need one entity to fit in one task.

A window `partition by entity` sends every row of an entity to one task, so a single hot entity
decides the run time. The two tools here split an entity's history instead:

* `running` cuts it into *cells* (entity x calendar unit). Rows are windowed inside their cell, each
  cell is summarised to one row, summaries are scanned per entity (one row per calendar unit), and
  what came before a cell is joined back on (entity, cell). The row side is already hash
  partitioned on that key, so the join moves only the summaries.
* `looking_back` cuts it into *blocks* of a fixed number of consecutive rows and copies the last few
  rows of each block into the next one. Any window with a bounded look-back is then local to a block.
* `overlapping` cuts it into *chunks* of whole cells and copies the cells just before a chunk into it, so that
  both tools above work inside chunks, and many steps share the one shuffle by (entity, chunk).

All give the same values as the plain window; only the distribution differs. Where the largest
entity is known to be small (`measured`), the plain window is used instead: it needs one shuffle by
entity, which all later steps on the same entity share.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.session import settle, small_side

CELL = "_cell"
CHUNK, OWN = "_chunk", "_own_row"
UNITS = ("year", "month", "week", "day", "hour", "minute", "second")
BLOCK_ROWS = 1024
# Up to this many first / last values a cell is summarised by aggregation, beyond it by its window.
MAX_PICKS = 4
# An entity of up to this many rows may be windowed in one task.
PLAIN_ROWS = 2_000_000


@dataclass(frozen=True)
class Track:
    """How rows form ordered histories.

    `unit` is the calendar unit of a cell: fine enough that one entity's rows within it fit a task,
    coarse enough that an entity has far fewer cells than rows. `cell` overrides it with any column
    that never decreases along the order (needed when `ts` is not a time). With `plain` an entity is
    not cut at all; set it through `measured`, which checks that entities are small.
    """

    entity: Sequence[str]
    ts: str
    tiebreak: Sequence[str] = ()
    unit: str = "day"
    cell: Column | None = field(default=None, compare=False)
    plain: bool = False

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tiebreak]

    def cell_column(self) -> Column:
        return self.cell if self.cell is not None else F.date_trunc(self.unit, F.col(self.ts))

    def placed(self) -> Column:
        """Whether a row has its entity and its time. Rows without either belong to no history."""
        found = F.col(self.ts).isNotNull() if self.cell is None else F.col(self.ts).isNotNull() & self.cell.isNotNull()
        for c in self.entity:
            found = found & F.col(c).isNotNull()
        return found


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Row count of the largest group: a count per group, combined map-side."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def measured(df: DataFrame, track: Track, max_rows: int = PLAIN_ROWS) -> Track:
    """The track fitted to the data: `plain` if no entity has more than `max_rows` rows, else split.

    A split track keeps its `unit` if no cell exceeds `max_rows` and otherwise takes the first finer
    unit that holds it. Each look is one count, combined map-side over the key columns alone.
    """
    if track.entity and largest_group(df, track.entity) <= max_rows:
        return replace(track, plain=True)
    if track.cell is not None or track.unit not in UNITS:
        return replace(track, plain=False)
    for unit in UNITS[UNITS.index(track.unit):]:
        fitted = replace(track, unit=unit, plain=False)
        if largest_group(df.withColumn(CELL, fitted.cell_column()), [*track.entity, CELL]) <= max_rows:
            break
    return fitted


def _plain_running(df: DataFrame, track: Track, position, sums, before, until, following, runs) -> DataFrame:
    """`running` with one window per entity; rows without a time come first in it and count for nothing."""
    ok = track.placed()
    w = Window.partitionBy(*track.entity).orderBy(*track.order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    onwards = w.rowsBetween(0, Window.unboundedFollowing)
    rank = position or "_rank"
    # sums and picks over nothing but such rows are NULL, which is what they get themselves
    sums, before, until, following = ({n: F.when(ok, c) for n, c in group.items()} for group in (sums, before, until, following))
    out = {
        **({rank: F.sum(F.when(ok, F.lit(1))).over(upto)} if position or runs else {}),
        **{n: F.sum(c).over(earlier) for n, c in sums.items()},
        **{n: F.last(c, ignorenulls=True).over(earlier) for n, c in before.items()},
        **{n: F.last(c, ignorenulls=True).over(upto) for n, c in until.items()},
        **{n: F.when(ok, F.first(c, ignorenulls=True).over(onwards)) for n, c in following.items()},
    }
    rows = df.withColumns({f"_r{i}": ~F.coalesce(c, F.lit(False)) for i, c in enumerate(runs.values())}) if runs else df
    rows = rows.withColumns(out)
    if runs:
        failed_at = [F.coalesce(F.max(F.when(F.col(f"_r{i}"), F.col(rank))).over(earlier), F.lit(0)) for i in range(len(runs))]
        rows = rows.withColumns({n: F.col(rank) - 1 - at for n, at in zip(runs, failed_at)})
        rows = rows.drop(*[f"_r{i}" for i in range(len(runs))], *([] if position else [rank]))
    return rows


def running(
    df: DataFrame,
    track: Track,
    *,
    position: str | None = None,
    sum_before: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    last_until: Mapping[str, Column] | None = None,
    next_from: Mapping[str, Column] | None = None,
    run_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add unbounded running values per entity; every keyword maps output name -> input column.

    The order must be unique within an entity. Rows whose entity or time is NULL stay, with NULL in every
    added column, and do not count for others, split or not.

    position     1-based rank of the row
    sum_before   sum over the rows strictly before (NULL when there is no value yet)
    last_before  last non-null value strictly before the row
    last_until   last non-null value up to and including the row
    next_from    first non-null value from the row onwards
    run_before   rows since the last one where the given condition failed, counting earlier rows only
    """
    sums = dict(sum_before or {})
    before = dict(last_before or {})
    until = dict(last_until or {})
    following = dict(next_from or {})
    runs = dict(run_before or {})
    rank_needed = bool(position or runs)
    if track.plain:
        return _plain_running(df, track, position, sums, before, until, following, runs)

    keys = [*track.entity, CELL]
    inside = Window.partitionBy(*keys).orderBy(*track.order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    onwards = inside.rowsBetween(0, Window.unboundedFollowing)
    order = F.struct(*track.order)

    # Inputs are materialised under private names so that outputs may reuse column names.
    inputs: dict[str, Column] = {}
    for tag, group in (("s", sums), ("b", before), ("u", until), ("n", following), ("r", runs)):
        for i, column in enumerate(group.values()):
            inputs[f"_{tag}{i}"] = column if tag == "r" else F.when(track.placed(), column)
    rows = df.withColumns({CELL: track.cell_column(), "_ok": track.placed(), **inputs})
    if runs:
        rows = rows.withColumn("_rn", F.row_number().over(inside))
    failed = [F.col("_ok") & ~F.coalesce(F.col(f"_r{i}"), F.lit(False)) for i in range(len(runs))]

    # One summary row per (entity, cell): what it counts, sums up, and holds last or first.
    picked = [*[("b", i, True) for i in range(len(before))], *[("u", i, True) for i in range(len(until))],
              *[("n", i, False) for i in range(len(following))]]
    if runs or len(picked) > MAX_PICKS:
        # Many picks, or ranks: read them off the cell's window, on its first row.
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        values = {"_n": F.count(F.when(F.col("_ok"), 1)).over(whole)}
        values.update({f"_cs{i}": F.sum(f"_s{i}").over(whole) for i in range(len(sums))})
        for tag, i, last in picked:
            end = F.last if last else F.first
            values[f"_c{tag}{i}"] = end(f"_{tag}{i}", ignorenulls=True).over(whole)
        values.update({f"_cr{i}": F.max(F.when(failed[i], F.col("_rn"))).over(whole) for i in range(len(runs))})
        if not runs:
            values["_rn"] = F.row_number().over(inside)
        summary = rows.withColumns(values).where(F.col("_rn") == 1).select(*keys, *[v for v in values if v != "_rn"])
    else:
        # Few picks: sums and picks combine map-side, so a hot cell sends one row per task.
        aggs = [F.count(F.when(F.col("_ok"), 1)).alias("_n"), *[F.sum(f"_s{i}").alias(f"_cs{i}") for i in range(len(sums))]]
        for tag, i, last in picked:
            column = F.col(f"_{tag}{i}")
            pick = F.max_by if last else F.min_by
            aggs.append(pick(column, F.when(column.isNotNull(), order)).alias(f"_c{tag}{i}"))
        summary = rows.groupBy(*keys).agg(*aggs)

    # Scan the summaries: what an entity has accumulated before each cell.
    scan = Window.partitionBy(*track.entity).orderBy(CELL)
    prior = scan.rowsBetween(Window.unboundedPreceding, -1)
    later = scan.rowsBetween(1, Window.unboundedFollowing)
    carried: dict[str, Column] = {}
    if rank_needed:
        carried["_rows"] = F.coalesce(F.sum("_n").over(prior), F.lit(0))
    for i in range(len(sums)):
        carried[f"_ps{i}"] = F.sum(f"_cs{i}").over(prior)
    for i in range(len(before)):
        carried[f"_pb{i}"] = F.last(f"_cb{i}", ignorenulls=True).over(prior)
    for i in range(len(until)):
        carried[f"_pu{i}"] = F.last(f"_cu{i}", ignorenulls=True).over(prior)
    for i in range(len(following)):
        carried[f"_pn{i}"] = F.first(f"_cn{i}", ignorenulls=True).over(later)
    summary = summary.withColumns(carried)
    if runs:
        summary = summary.withColumns(
            {f"_pr{i}": F.max(F.col("_rows") + F.col(f"_cr{i}")).over(prior) for i in range(len(runs))}
        )
        carried.update({f"_pr{i}": F.lit(None) for i in range(len(runs))})
    carry = summary.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *carried)

    local: dict[str, Column] = {}
    if position and not runs:
        local["_rn"] = F.row_number().over(inside)
    for i in range(len(sums)):
        local[f"_ls{i}"] = F.sum(f"_s{i}").over(earlier)
    for i in range(len(before)):
        local[f"_lb{i}"] = F.last(f"_b{i}", ignorenulls=True).over(earlier)
    for i in range(len(until)):
        local[f"_lu{i}"] = F.last(f"_u{i}", ignorenulls=True).over(upto)
    for i in range(len(following)):
        local[f"_ln{i}"] = F.first(f"_n{i}", ignorenulls=True).over(onwards)
    for i in range(len(runs)):
        local[f"_lr{i}"] = F.max(F.when(failed[i], F.col("_rn"))).over(earlier)
    rows = rows.withColumns(local) if local else rows

    # Plain equality keeps the rows' (entity, cell) partitioning; null-safe equality would reshuffle.
    # Rows it misses, without an entity or a time, have masked inputs and get NULL below.
    match = [rows[k] == carry[f"_k{j}"] for j, k in enumerate(keys)]
    joined = rows.join(carry, match, "left")

    outputs: dict[str, Column] = {}
    if position:
        outputs[position] = F.col("_rows") + F.col("_rn")
    for i, name in enumerate(sums):
        carried_sum, local_sum = F.col(f"_ps{i}"), F.col(f"_ls{i}")
        outputs[name] = F.when(
            carried_sum.isNotNull() & local_sum.isNotNull(), carried_sum + local_sum
        ).otherwise(F.coalesce(carried_sum, local_sum))
    for tag, group in (("b", before), ("u", until), ("n", following)):
        for i, name in enumerate(group):
            outputs[name] = F.coalesce(F.col(f"_l{tag}{i}"), F.col(f"_p{tag}{i}"))
    for i, name in enumerate(runs):
        failed_at = F.coalesce(F.col("_rows") + F.col(f"_lr{i}"), F.col(f"_pr{i}"), F.lit(0))
        outputs[name] = F.col("_rows") + F.col("_rn") - 1 - failed_at
    kept = [c for c in df.columns if c not in outputs]
    return joined.select(*[rows[c] for c in kept], *[F.when(F.col("_ok"), c).alias(n) for n, c in outputs.items()])


def looking_back(
    df: DataFrame,
    entity: Sequence[str],
    position: str,
    lookback: int,
    columns: Callable[[WindowSpec, Column], Mapping[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns whose frame reaches at most `lookback` rows back (or ahead, if negative).

    `columns(window, offset)` gets the block-local ordered window and the row's offset from the start
    of its block (negative on copied rows). Blocks have `block_rows` rows whatever the entity's size.
    """
    reach = abs(lookback)
    size = max(block_rows, reach)
    # rows without a position are in no history: a block each, where nothing is earlier
    apart = -1 - F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]).bitwiseAND(F.lit((1 << 62) - 1))
    block = F.coalesce(F.floor((F.col(position) - 1) / size), apart)
    within = (F.col(position) - 1) % size
    if lookback >= 0:
        also, neighbour = within >= size - reach, block + 1
    else:
        also, neighbour = (within < reach) & (block > 0), block - 1
    rows = df.withColumn("_own", block).withColumn(
        "_block", F.explode(F.when(also, F.array(block, neighbour)).otherwise(F.array(block)))
    )
    window = Window.partitionBy(*entity, "_block").orderBy(position)
    offset = F.col(position) - 1 - F.col("_block") * size
    return (
        rows.withColumns(dict(columns(window, offset)))
        .where(F.col("_block") == F.col("_own"))
        .drop("_block", "_own")
    )


#: A chunk has so many cells at least, unless the finest unit is coarser.
CELLS_A_CHUNK = 16


def overlapping(df: DataFrame, track: Track, reach: int, rows: int, within: Sequence[str] = ()) -> DataFrame:
    """The rows by `CHUNK`, about `rows` consecutive ones of an entity, with copies (`OWN` is false) of those before.

    Copied are at least the last `reach` rows of the entity before the chunk, and the last `reach` of each value of `within`.
    Chunks are made of whole cells, whose counts are all that is looked at: the first unit from the track's on whose largest cell is
    a small part of a chunk. Rows without entity or time are in chunks of their own.
    """
    for unit in UNITS[UNITS.index(track.unit):] if track.cell is None and track.unit in UNITS else [track.unit]:
        fitted = replace(track, unit=unit)
        placed = df.where(fitted.placed()).withColumn(CELL, fitted.cell_column())
        counts = settle(placed.groupBy(*track.entity, *within, CELL).agg(F.count(F.lit(1)).alias("_n")))
        largest = counts.groupBy(*track.entity, CELL).agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0] or 0
        if largest * CELLS_A_CHUNK <= rows:
            break
    history, whole = Window.partitionBy(*track.entity), Window.partitionBy(*track.entity, CELL)
    before = F.sum("_n").over(history.orderBy(CELL).rangeBetween(Window.unboundedPreceding, 0)) - F.sum("_n").over(whole)
    cells = counts.withColumn("_before", before).withColumn("_first", F.floor(F.col("_before") / rows))
    ahead = lambda w, at: F.max("_first").over(w.orderBy(at).rangeBetween(0, largest + reach - 1))
    last = [ahead(history, "_before")]
    if within:
        apart = Window.partitionBy(*track.entity, *within)
        cells = cells.withColumn("_apart", F.sum("_n").over(apart.orderBy(CELL).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        last.append(ahead(apart, "_apart"))
    cells = cells.withColumn("_last", F.greatest(*last) if within else last[0])
    keys = [*track.entity, *within, CELL]
    cells = small_side(cells.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], "_first", "_last"))
    found = df.withColumn(CELL, fitted.cell_column())
    found = found.join(cells, [found[k].eqNullSafe(cells[f"_k{j}"]) for j, k in enumerate(keys)], "left")
    alone = -1 - F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]).bitwiseAND(F.lit((1 << 62) - 1))
    chunks = F.coalesce(F.sequence("_first", "_last"), F.array(alone))
    own = F.col("_first").isNull() | (F.col(CHUNK) == F.col("_first"))
    return found.select(*df.columns, "_first", F.explode(chunks).alias(CHUNK)).select(*df.columns, CHUNK, own.alias(OWN))


#: Most rows of a group whose values one task counts for its quantiles.
EXACT_ROWS = 1_000_000


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    also: Sequence[Column] = (),
    at_most: int = EXACT_ROWS,
) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, and aggregates `also` beside them. Groups without a value have no row, or with `also` NULLs.

    Groups of up to `at_most` rows are counted first: if all are that small, one aggregation does it. Otherwise values are sorted over
    range partitions, so a large group is spread over tasks.
    """
    group = list(group)
    present = df.where(F.col(value).isNotNull())
    if largest_group(present, group) <= at_most:
        rows = df if also else present
        found = rows.groupBy(*group).agg(*also, F.percentile(F.col(value).cast("double"), [float(p) for p in probs]).alias("_q"))
        return found.select("*", *[F.get("_q", i).alias(n) for i, n in enumerate(names)]).drop("_q")
    ranked = _ranked_quantiles(present.select(*group, F.col(value).cast("double").alias("_x")), group, probs, names)
    if not also:
        return ranked
    others = df.groupBy(*group).agg(*also)
    return others.join(ranked, group, "left") if group else others.crossJoin(F.broadcast(ranked))  # one row


def _ranked_quantiles(values: DataFrame, group: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles of `_x` by rank: values are counted, sorted by (group, value) in ranges, and counts per range say where each rank lies.

    Only the ranges that hold a wanted rank are read again, and ranked range by range. Equal values are counted, not repeated.
    """
    counted = values.groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranges = settle(counted.repartitionByRange(*group, "_x").withColumn("_part", F.spark_partition_id()))
    scan = Window.partitionBy(*group).orderBy("_part")  # a row per range
    ends = (
        ranges.groupBy(*group, "_part")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_hi", F.sum("_n").over(scan.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )
    ranks = []
    for i, p in enumerate(probs):
        exact = (F.col("_total") - 1) * F.lit(float(p))
        ranks.append(F.struct(F.lit(i).alias("q"), F.lit(0).alias("end"), F.floor(exact).alias("rank"), exact.alias("at")))
        ranks.append(F.struct(F.lit(i).alias("q"), F.lit(1).alias("end"), F.ceil(exact).alias("rank"), exact.alias("at")))
    wanted = (
        ends.withColumn("_w", F.filter(F.array(*ranks), lambda w: (w["rank"] >= F.col("_lo")) & (w["rank"] < F.col("_hi"))))
        .where(F.size("_w") > 0)
        .select(*group, "_part", "_lo", "_w")
    )
    inside = Window.partitionBy(*group, "_part").orderBy("_x")
    hits = (
        ranges.join(wanted, [*group, "_part"])
        .withColumn("_to", F.col("_lo") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_w", F.filter("_w", lambda w: (w["rank"] >= F.col("_to") - F.col("_n")) & (w["rank"] < F.col("_to"))))
        .select(*group, "_x", F.explode("_w").alias("_w"))
    )
    found = []
    for i, name in enumerate(names):
        low = F.max(F.when((F.col("_w.q") == i) & (F.col("_w.end") == 0), F.col("_x")))
        high = F.max(F.when((F.col("_w.q") == i) & (F.col("_w.end") == 1), F.col("_x")))
        at = F.max(F.when(F.col("_w.q") == i, F.col("_w.at")))
        found.append((low + (at - F.floor(at)) * (high - low)).alias(name))
    return hits.groupBy(*group).agg(*found)
