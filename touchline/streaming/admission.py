"""Admission rule: at most `limit` events per key within any `window_seconds`; rejected ones do not count.

An event is admitted when fewer than `limit` admitted events of its key lie less than `window_seconds`
before it. Events of one time are taken in the order of their ids. Events without a time are not admitted; a NULL key is a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructType

from touchline.session import settle

#: What a streaming query needs: state that holds lists and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate:
    """The rule for one key: the last admitted times, at most `limit`."""

    def __init__(self, limit: int, span: int, times: list[int] | None = None):
        self.limit, self.span, self.times = limit, span, deque(times or [])

    def admits(self, us: int) -> bool:
        while self.times and us - self.times[0] >= self.span:
            self.times.popleft()
        fits = len(self.times) < self.limit
        if fits:
            self.times.append(us)
        return fits


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, limit: int, span: int) -> Iterator[pa.RecordBatch]:
    """Events in order with a verdict, and whether it may depend on the range before; at last rows for the first key and for the state after all events.

    The verdict of a range's first key may depend on earlier ranges until a gap of a window, after which nothing
    admitted before counts.
    """
    part, gate, key, last, open_ = TaskContext.get().partitionId(), None, None, None, True
    first: tuple | None = None
    for batch in batches:
        keys, moments, ids = (c.to_pylist() for c in batch.columns)
        admitted, opened = [], []
        for k, us in zip(keys, moments):
            if gate is None or k != key:
                open_ = first is None
                first = first or (k, us)
                gate, key, last = Gate(limit, span), k, us
            if open_ and us - last >= span:
                open_ = False
            last = us
            admitted.append(gate.admits(us))
            opened.append(open_)
        n = len(keys)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), batch.column(2), pa.array(admitted, pa.bool_()), pa.array(opened, pa.bool_()), pa.array([part] * n, pa.int32()),
            pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int64())),
        ], schema=schema)
    if gate is not None:
        ends = [{"of": "first", "k": first[0], "us": first[1], "times": []}, {"of": "last", "k": key, "us": last, "times": list(gate.times)}]
        yield pa.RecordBatch.from_pylist([{schema.names[0]: e["k"], schema.names[1]: e["us"], "open": open_, "part": part, "of": e["of"], "times": e["times"]} for e in ends], schema)


def _again(batches: Iterator[pa.RecordBatch], schema: pa.Schema, limit: int, span: int, states: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """Events of whole chains, each from its state before."""
    chain, gate = None, None
    for batch in batches:
        fits = []
        for now, us in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if now != chain:
                chain, gate = now, Gate(limit, span, states[now])
            fits.append(gate.admits(us))
        chosen = batch.filter(pa.array(fits, pa.bool_()))
        yield pa.RecordBatch.from_arrays([chosen.column(1), chosen.column(3)], schema=schema)


def chains(ends: list, key: str, span: int) -> tuple[dict[int, int], dict[int, list[int]]]:
    """From the first key and the last state of each range, in order: the chain of each range that goes on from the one before, and each chain's state before.

    A range whose last state depends on the state before it passes the question on to the next one.
    """
    firsts, lasts = {r["part"]: r for r in ends if r["of"] == "first"}, {r["part"]: r for r in ends if r["of"] == "last"}
    chain_of: dict[int, int] = {}
    states: dict[int, list[int]] = {}
    parts = sorted(lasts)
    for before, now in zip(parts, parts[1:]):
        last, first = lasts[before], firsts[now]
        if last[key] != first[key] or first["_us"] - last["_us"] >= span:
            continue
        if last["open"] and before in chain_of:
            chain_of[now] = chain_of[before]
        else:
            chain_of[now], states[now] = now, last["times"]
    return chain_of, states


def admit(events: DataFrame, *, key: str, ts: str, event_id: str, limit: int, window_seconds: int) -> DataFrame:
    """Batch form: the admitted events as (key, event_id).

    One sort by (key, time) in ranges, so a hot key is spread over tasks, and one scan of every range that carries the last admitted
    times. A scan starts without those of the range before; that matters only until the first gap of a window. So one more scan
    takes up the events before the first gap in ranges that go on with the key of the range before, with the right state. Ranges without such a gap
    form a chain with the next one and are scanned in sequence, as the rule itself is; no scan holds more than `limit` times. The driver
    sees two rows per range.
    """
    span = window_seconds * 1_000_000
    rows = events.where(F.col(ts).isNotNull()).select(F.col(key), F.unix_micros(F.col(ts)).alias("_us"), F.col(event_id))
    ordered = rows.repartitionByRange(key, "_us", event_id).sortWithinPartitions(key, "_us", event_id)
    seen = StructType([*rows.schema.fields, *StructType.fromDDL("admitted boolean, open boolean, part int, of string, times array<long>").fields])
    scanned = settle(ordered.mapInArrow(partial(_scan, schema=to_arrow_schema(seen), limit=limit, span=span), seen))
    done = scanned.where(F.col("of").isNull())
    chain_of, states = chains(scanned.where(F.col("of").isNotNull()).select(key, "_us", "open", "part", "of", "times").collect(), key, span)
    if not chain_of:
        return done.where("admitted").select(key, event_id)
    number = F.create_map(*[F.lit(x) for pair in chain_of.items() for x in pair])[F.col("part")]
    doubtful = F.col("open") & number.isNotNull()
    kept = done.where(F.col("admitted") & ~doubtful).select(key, event_id)
    chained = done.where(doubtful).select(number.alias("_chain"), key, "_us", event_id)
    out = StructType([rows.schema[0], rows.schema[2]])
    redone = chained.repartition("_chain").sortWithinPartitions("_chain", "_us", event_id)
    return kept.unionByName(redone.mapInArrow(partial(_again, schema=to_arrow_schema(out), limit=limit, span=span, states=states), out))


class Admission(StatefulProcessor):
    """Events wait in the key's state until the watermark has passed them, then they are taken in the order of their times."""

    def __init__(self, key: str, event_id: str, id_type: str, limit: int, span: int):
        self.key, self.event_id, self.id_type, self.limit, self.span = key, event_id, id_type, limit, span

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, id {self.id_type}")
        self.admitted = handle.getListState("admitted", "us long")

    def _wake(self, at_ms: int) -> None:
        if at_ms not in {t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()}:
            self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            new = list(zip(batch["us"].tolist(), batch[self.event_id].tolist()))
            if new:
                self.waiting.appendList(new)
                here = min(us for us, _ in new)
                least = here if least is None else min(least, here)
        if least is not None:
            self._wake(max(least // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = [w for w in waiting if w[0] // 1000 < passed]
        gate = Gate(self.limit, self.span, [r[0] for r in self.admitted.get()])
        chosen = [w for w in ready if gate.admits(w[0])]
        rest = waiting[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        times = [t for t in gate.times if (t + self.span) // 1000 >= passed]
        self.admitted.put([(t,) for t in times]) if times else self.admitted.clear()
        if rest:
            self._wake(rest[0][0] // 1000 + 1)
        elif times:  # to forget them
            self._wake(max((times[-1] + self.span) // 1000, passed) + 1)
        if chosen:
            yield pd.DataFrame({self.key: [key[0]] * len(chosen), self.event_id: [i for _, i in chosen], "us": [us for us, _ in chosen]})

    def close(self) -> None:
        pass


def admit_stream(
    events: DataFrame, *, key: str, ts: str, event_id: str, limit: int, window_seconds: int, delay: str = "0 seconds"
) -> DataFrame:
    """Streaming form: admitted events, released once the watermark has passed them.

    Events may come in any order within `delay`; later ones are dropped. A key's state is the events that wait and
    the last `limit` admitted times; it is cleared a window after the last admission. The session has to use `STATE_STORE`.
    """
    span = window_seconds * 1_000_000
    schema = StructType([events.schema[key], events.schema[event_id]]).add("us", LongType())
    processor = Admission(key, event_id, events.schema[event_id].dataType.simpleString(), limit, span)
    return (
        events.withWatermark(ts, delay)
        .withColumn("us", F.unix_micros(ts))
        .select(key, event_id, "us", ts)
        .groupBy(key)
        .transformWithStateInPandas(processor, schema, "append", "eventTime")
    )
