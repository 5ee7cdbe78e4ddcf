"""Sources, store, pipelines and the admission rule in batch and streaming form."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions.config import StrengthConfig
from touchline.plans import pipelines
from touchline.session import broadcast_within, checkpoint_dir
from touchline.sources import matches, ratings, store
from touchline.streaming import admission

CONFIG = StrengthConfig(replicates=3, steps=2, tolerance=0.0, max_goals=8)


def land(root, league, season, lines):
    folder = root / f"league={league}" / f"season={season}"
    os.makedirs(folder)
    (folder / "part.json").write_text("\n".join(lines))


def record(i, when, h, a, gh, ga):
    side = lambda t: {"title": f"{t} FC", "short_title": t}
    return json.dumps({"id": str(i), "datetime": when, "h": side(h), "a": side(a), "goals": {"h": gh, "a": ga}, "xG": {"h": "1.0", "a": "0.5"}})


@pytest.fixture(scope="module")
def feed(tmp_path_factory):
    root = tmp_path_factory.mktemp("feed")
    teams, start, i = list("ABCD"), dt.datetime(2024, 8, 17, 15), 0
    lines = []
    for week in range(8):
        order = teams[week % 4:] + teams[: week % 4]
        for h, a in ((order[0], order[1]), (order[2], order[3])):
            played = week < 6
            lines.append(record(i, f"{start + dt.timedelta(days=7 * week)}", h, a, str((i * 7) % 4) if played else None, str((i * 5) % 3) if played else None))
            i += 1
    land(root, "EPL", "2024", lines + ['{"id": broken'])
    land(root, "Serie_A", "2024", [record(99, "2024-08-17 18:00:00", "X", "Y", "1", "1")])
    return str(root)


def test_scan_prunes_partitions_and_quarantines(spark, feed):
    df = matches.read_matches(spark, feed, ["EPL"], ["2024"])
    assert df.count() == 16 and df.schema["season"].dataType.simpleString() == "string"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "league" in plan.split("PartitionFilters")[1].split("]")[0]
    bad = matches.quarantine(spark, feed).collect()
    assert len(bad) == 1 and "broken" in bad[0]["_corrupt_record"]
    with pytest.raises(ValueError, match="no match data"):
        matches.read_matches(spark, feed, ["Ligue_1"])
    report = {(r["league"], r["season"]): r["status"] for r in matches.request_report(spark, feed, ["EPL", "Ligue_1"], ["2024"]).collect()}
    assert report == {("EPL", "2024"): "ok", ("Ligue_1", "2024"): "missing"}


def test_match_files_round_trip(spark, feed, tmp_path):
    out = str(tmp_path / "copy")
    matches.write_matches(matches.read_matches(spark, feed), out)
    assert matches.read_matches(spark, out, seasons=["2024"]).count() == 17


def test_rating_files_drop_missing_ratings(spark, tmp_path):
    path = tmp_path / "elo.csv"
    path.write_text("Rank,Club,Country,Level,Elo,From,To\n1,Man City,ENG,1,1900.5,2024-01-01,2024-01-05\nNone,Leeds,ENG,1,,2024-01-01,2024-01-05\n")
    rows = ratings.read_ratings(spark, str(path)).collect()
    assert [(r["Club"], r["Elo"], r["From"]) for r in rows] == [("Man City", 1900.5, dt.date(2024, 1, 1))]


def test_store_replaces_only_its_rounds(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "round int, v string")
    store.write_round_table(df, root, "predictions")
    store.write_round_table(spark.createDataFrame([(2, "c")], "round int, v string"), root, "predictions")
    assert store.read_round(spark, root, "predictions", 1).first()["v"] == "a"
    assert store.read_round(spark, root, "predictions", 2).first()["v"] == "c"
    with pytest.raises(LookupError):
        store.read_round(spark, root, "predictions", 3)
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, root, "actuals")
    inv = {r["round"]: r["has_actuals"] for r in store.stored_inventory(spark, root).collect()}
    assert inv == {1: False, 2: False}


def test_round_folders(spark, tmp_path):
    for n in (3, 12):
        os.makedirs(tmp_path / f"round_{n}")
        (tmp_path / f"round_{n}" / "actuals.json").write_text(json.dumps({"actuals": [{"home_team": "A", "goals_home": n}]}, indent=2))
    df = store.read_round_folders(spark, str(tmp_path), "actuals.json", "actuals array<struct<home_team string, goals_home int>>")
    assert sorted((r["round"], r["actuals"][0]["goals_home"]) for r in df.collect()) == [(3, 3), (12, 12)]


def test_round_selection(spark):
    done = spark.createDataFrame([(r,) for r in range(1, 11)], "round int")
    pick = lambda **k: sorted(r[0] for r in store.rounds_to_process(done, **k).collect())
    assert pick() == list(range(2, 11))
    assert pick(start_round=3, end_round=9, skip_rounds=[4], step=2) == [3, 6, 8]
    finished = spark.createDataFrame([(3,)], "round int")
    assert pick(end_round=4, finished=finished) == [2, 4]


def test_backtest_job(spark, feed, tmp_path):
    rows = pipelines.prepare(matches.read_matches(spark, feed, ["EPL"]))
    as_of = F.lit("2024-09-23").cast("timestamp")
    root = str(tmp_path / "rounds")
    assert pipelines.backtest_season(rows, as_of, root, step=2, config=CONFIG) == [2, 4, 6]
    inventory = {r["round"]: (r["has_predictions"], r["has_actuals"], r["has_team_strengths"]) for r in store.stored_inventory(spark, root).collect()}
    assert inventory == {r: (True, True, True) for r in (2, 4, 6)}
    rec = store.read_round(spark, root, "predictions", 4).first()
    assert len(rec["most_likely_scores"]) == 10 and rec["expected_goals_home"]["mean"] > 0
    path = store.read_round(spark, root, "team_strengths", 4).where("team_id = 'A'").first()
    assert [p["t"] for p in path["attack"]] == [1, 2, 3] and path["home_adv"] is not None
    assert store.read_round(spark, root, "actuals", 4).count() == 2
    assert pipelines.backtest_season(rows, as_of, root, end_round=4, skip_existing=True, config=CONFIG) == [3]
    again = store.read_round(spark, root, "team_strengths", 3).where("team_id = 'A'").first()
    assert [p["mean"] for p in again["attack"]] == [p["mean"] for p in path["attack"]][:2]


def test_leagues_have_calendars_of_their_own(spark, feed):
    raw = matches.read_matches(spark, feed, ["EPL"])
    other = raw.withColumns({"league": F.lit("Other"), "datetime": F.date_format(F.col("datetime").cast("timestamp") + F.expr("INTERVAL 14 DAYS"), "yyyy-MM-dd HH:mm:ss")})
    both = pipelines.prepare(raw.unionByName(other), keep=("season", "league"), group=("league",))
    alone = pipelines.prepare(raw, keep=("season", "league"))
    rounds_of = lambda df: sorted((r["cum_round"], r["count"]) for r in df.groupBy("cum_round").count().collect())
    assert rounds_of(both.where("league = 'EPL'")) == rounds_of(both.where("league = 'Other'")) == rounds_of(alone)


def test_train_then_predict(spark, feed, tmp_path):
    rows = pipelines.prepare(matches.read_matches(spark, feed, ["EPL"]))
    as_of = F.lit("2024-09-25").cast("timestamp")
    root = str(tmp_path / "runs")
    assert pipelines.train(rows, as_of, "r1", root, CONFIG) == 7
    draws = store.load_run(spark, root, "r1", "draws")
    out = pipelines.predict_next(rows, as_of, draws, CONFIG).collect()
    assert len(out) == 2 and {r["round"] for r in out} == {7}
    with pytest.raises(LookupError, match="no trained run"):
        store.load_run(spark, root, "r2", "draws")
    thin = pipelines.predict_next(rows, as_of, draws, StrengthConfig(max_goals=8, sample_draws=2, top_scores=3)).first()
    assert len(thin["most_likely_scores"]) == 3
    obs = store.load_run(spark, root, "r1", "observations").limit(4)
    named = obs.withColumns({"t": F.lit(6), "team_id": F.lit("A"), "opp_id": F.lit("B")})
    config = StrengthConfig(use_xg=True, use_opponent_adjusted_xg=True, use_form_decomposition=True)
    assert pipelines.fitted_rates(named, draws, config).count() == 4 * 3 and config.fit_decay == config.form_decay
    status = store.run_status(store.read_table(spark, root, "runs")).first()
    assert status["model_trained"] and status["run_id"] == "r1"
    with pytest.raises(ValueError, match="no upcoming"):
        pipelines.predict_next(rows, F.lit("2030-01-01").cast("timestamp"), draws, CONFIG)


def greedy(events, limit, window):
    admitted, state = set(), {}
    for key, us, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        live = [t for t in state.get(key, []) if us - t < window * 1_000_000]
        if len(live) < limit:
            live.append(us)
            admitted.add(i)
        state[key] = live
    return admitted


@pytest.fixture(scope="module")
def stream_rows():
    rng = random.Random(8)
    out, i = [], 0
    for key, gap in (("dense", 7), ("mixed", 40), ("sparse", 300)):
        us = 0
        for _ in range(300):
            us += rng.choice([1, gap, gap, 60]) * 1_000_000
            out.append((key, us, i))
            i += 1
    return out + [("edge", 0, 10001), ("edge", 60_000_000, 10002), ("edge", 119_999_999, 10003)]


@pytest.mark.parametrize("limit", [1, 3])
def test_admission_batch_equals_greedy(spark, stream_rows, limit):
    df = spark.createDataFrame(stream_rows, "k string, us long, id long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"] for r in admission.admit(df, key="k", ts="ts", event_id="id", limit=limit, window_seconds=60).collect()}
    assert got == greedy(stream_rows, limit, 60)
    if limit == 1:
        assert {10001, 10002} <= got and 10003 not in got


@pytest.mark.parametrize("limit", [1, 4])
def test_admission_of_a_hot_dense_key(spark, limit):
    """A third of all events on one key without any gap, over many ranges: one more scan settles what crosses them."""
    rng, rows, us = random.Random(limit), [], 0
    for i in range(100_000):
        us += rng.randrange(1, 3_000_000)
        rows.append(("hot", us, i))
    rows += [(f"k{i % 97}", rng.randrange(us), 200_000 + i) for i in range(150_000)]
    rows += [(None, rng.randrange(us), 400_000 + i) for i in range(50_000)] + [("tie", 5, 500_000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, us long, id long").withColumn("ts", F.timestamp_micros("us"))
    late = spark.createDataFrame([("hot", 600_000)], "k string, id long").select("k", F.lit(0).cast("long").alias("us"), "id", F.lit(None).cast("timestamp").alias("ts"))
    got = [r["id"] for r in admission.admit(df.union(late), key="k", ts="ts", event_id="id", limit=limit, window_seconds=60).collect()]
    want = greedy([(k or "", us, i) for k, us, i in rows], limit, 60)
    assert len(got) == len(set(got)) and set(got) == want


def test_admission_chains():
    def ends(part, first, last, open_, times):
        return [dict(part=part, of="first", k=first[0], _us=first[1], open=open_, times=[]), dict(part=part, of="last", k=last[0], _us=last[1], open=open_, times=times)]

    rows = ends(0, ("a", 0), ("b", 5), False, [5]) + ends(1, ("b", 6), ("b", 9), True, [6]) + ends(2, ("b", 9), ("c", 1), False, [1]) + ends(4, ("c", 50), ("c", 60), True, [60])
    chain_of, states = admission.chains(rows, "k", 10)
    assert chain_of == {1: 1, 2: 1} and states == {1: [5]}


def test_admission_of_nothing(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, id long")
    assert admission.admit(df, key="k", ts="ts", event_id="id", limit=1, window_seconds=60).collect() == []


@pytest.mark.parametrize("delay", [600, 3600])
def test_admission_stream_equals_greedy_on_shuffled_events(spark, stream_rows, tmp_path, delay):
    """Files hold events out of order, as late as the watermark allows, and the order of times decides, not that of arrival."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admission.STATE_STORE)
    source, rng = str(tmp_path / "in"), random.Random(delay)
    arrival = sorted(stream_rows, key=lambda e: e[1] + rng.randrange(delay * 900_000))
    schema = "k string, us long, id long"
    os.makedirs(source)
    size = len(arrival) // 6 + 1
    for n in range(6):
        part = arrival[n * size : (n + 1) * size] + ([("flush", 10**13, 10**6)] if n == 5 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).select("k", "id", F.timestamp_micros(F.col("us") + 86_400_000_000).alias("ts"))
    out = admission.admit_stream(df, key="k", ts="ts", event_id="id", limit=3, window_seconds=60, delay=f"{delay} seconds")
    name = f"admitted_{delay}"
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    got = [r["id"] for r in spark.sql(f"select id from {name}").collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(stream_rows, 3, 60)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    df = spark.range(10)
    assert broadcast_within(df, 5) is df and broadcast_within(df, 10) is not df
