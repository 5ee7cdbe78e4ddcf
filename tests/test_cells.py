"""Split-history primitives against plain windows, with a hot entity and tiny cells and blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators.cells import Track, looking_back, measured, quantiles, running


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    n = 600
    # Entity "hot" holds most rows; many rows share a time.
    entity = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n) * 6, unit="h")
    x = np.where(rng.random(n) < 0.3, None, rng.integers(-5, 20, n))
    ids = rng.permutation(n)
    rows = [(str(entity[i]), ts[i].to_pydatetime(), int(ids[i]), None if x[i] is None else int(x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, id long, x long")
    return df.cache()


TRACK = Track(["entity"], "ts", ("id",))


@pytest.mark.parametrize("unit", ["hour", "day", "month", "plain"])
def test_running_equals_plain_window(series, unit):
    track = Track(["entity"], "ts", ("id",), unit)
    if unit == "plain":
        track = measured(series, track)
        assert track.plain and not measured(series, track, 100).plain
    got = running(
        series, track, position="pos", sum_before={"s": F.col("x")}, last_before={"lb": F.col("x")},
        last_until={"lu": F.col("x")}, next_from={"nf": F.col("x")}, run_before={"run": F.col("x") > 0},
    )
    w = Window.partitionBy("entity").orderBy("ts", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = series.select(
        "*", F.row_number().over(w).alias("p"), F.sum("x").over(before).alias("ps"),
        F.last("x", True).over(before).alias("plb"), F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("plu"),
        F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("pnf"),
    )
    failed = ~F.coalesce(F.col("x") > 0, F.lit(False))
    plain = plain.withColumn("prun", F.col("p") - 1 - F.coalesce(F.max(F.when(failed, F.col("p"))).over(before), F.lit(0)))
    both = got.join(plain.drop("entity", "ts", "x"), "id")
    pairs = [("pos", "p"), ("s", "ps"), ("lb", "plb"), ("lu", "plu"), ("nf", "pnf"), ("run", "prun")]
    bad = [F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(a) for a, b in pairs]
    assert both.count() == 600
    assert all(v == 0 for v in both.agg(*bad).first())


@pytest.mark.parametrize("block", [3, 7, 64])
@pytest.mark.parametrize("reach", [3, -3])
def test_looking_back_equals_plain_window(series, block, reach):
    at = F.lag("x", 3) if reach > 0 else F.lead("x", 3)
    placed = running(series, TRACK, position="pos")
    got = looking_back(placed, ["entity"], "pos", reach, lambda w, _: {"y": at.over(w)}, block)
    plain = series.select("id", at.over(Window.partitionBy("entity").orderBy("ts", "id")).alias("z"))
    both = got.join(plain, "id")
    assert both.count() == 600
    assert both.where(~F.col("y").eqNullSafe(F.col("z"))).count() == 0


@pytest.mark.parametrize("largest,unit", [(100, "day"), (30, "hour"), (2, "second")])
def test_measured_refines_the_unit_for_dense_entities(series, largest, unit):
    fitted = measured(series, TRACK, largest)
    assert (fitted.plain, fitted.unit) == (False, unit)
    got = running(series, fitted, position="pos").where("entity = 'hot'").agg(F.max("pos"), F.count_distinct("pos")).first()
    assert got[0] == got[1] == series.where("entity = 'hot'").count()


def test_running_without_entity_ranks_globally(series):
    got = running(series.select("ts", "id"), Track([], "ts", ("id",)), position="pos")
    assert got.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first() == (600, 1, 600)


def test_running_may_overwrite_its_input(series):
    got = running(series, TRACK, last_until={"x": F.col("x")})
    assert got.columns == ["entity", "ts", "id", "x"]


def test_rows_without_keys_stay_and_do_not_count(spark, series):
    odd = [(None, pd.Timestamp("2024-01-03").to_pydatetime(), 9001, 5), ("hot", None, 9002, 7), ("hot", None, 9003, None), (None, None, 9004, 1)]
    mixed = series.union(spark.createDataFrame(odd, series.schema))

    def values(rows, track):
        steps = running(
            rows, track, position="pos", sum_before={"s": F.col("x")}, last_before={"lb": F.col("x")},
            last_until={"lu": F.col("x")}, next_from={"nf": F.col("x")}, run_before={"run": F.col("x") > 0},
        )
        back = looking_back(steps, ["entity"], "pos", 2, lambda w, _: {"lag": F.lag("x", 2).over(w)}, 8)
        return {r["id"]: tuple(r)[4:] for r in back.collect()}

    plain, split = values(mixed, Track(["entity"], "ts", ("id",), plain=True)), values(mixed, TRACK)
    assert plain == split and len(split) == mixed.count()
    assert all(v is None for r in odd for v in split[r[2]])
    assert {k: v for k, v in split.items() if k < 9000} == values(series, TRACK)


@pytest.mark.parametrize("at_most", [0, 1_000_000])
@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e9])
def test_quantiles_are_exact_at_any_scale(series, at_most, scale):
    scaled = series.withColumn("x", F.col("x") * scale)
    found = quantiles(scaled, ["entity"], "x", [0.05, 0.5, 0.95], ["a", "b", "c"], [F.count("x").alias("n")], at_most)
    got = {r["entity"]: r for r in found.collect()}
    for entity, part in scaled.where("x is not null").toPandas().groupby("entity"):
        assert np.allclose([got[entity][k] for k in "abc"], np.percentile(part.x.astype(float), [5, 50, 95]), atol=0) and got[entity]["n"] == len(part)


@pytest.mark.parametrize("values", ["rand(3)", "floor(rand(3) * 3)", "rand(3) * 1e9"])
def test_quantiles_of_one_large_group(spark, values):
    """Spread over ranges: values all in [0, 1), mostly ties, and wide."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.expr(values).cast("double").alias("x")).cache()
    want = np.percentile([r[0] for r in df.select("x").collect()], [1, 50, 97.5])
    for group in (["g"], []):
        got = quantiles(df, group, "x", [0.01, 0.5, 0.975], ["a", "b", "c"], at_most=1000).first()
        assert np.allclose(got[len(group) :], want)
    df.unpersist()


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([("g", 2.5)], "g string, x double")
    assert quantiles(df, ["g"], "x", [0.05, 0.95], ["lo", "hi"]).first()[1:] == (2.5, 2.5)


def test_rows_of_a_hot_entity_spread_over_tasks(series):
    """No task of the row-side window holds the whole hot entity."""
    placed = running(series, Track(["entity"], "ts", ("id",), "day"), position="pos")
    per_group = series.groupBy("entity", F.date_trunc("day", "ts")).count().agg(F.max("count")).first()[0]
    hot = series.where("entity = 'hot'").count()
    assert per_group < hot / 4
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity" in plan and "_cell" in plan
