"""Health of routes: a state machine over observations, in batch and as a stream with the same steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: To which states a state may go.
ALLOWED = {
    "unknown": ["probing", "quarantined", "retired"],
    "probing": ["healthy", "degraded", "quarantined", "blocked", "retired"],
    "healthy": ["probing", "degraded", "quarantined", "blocked", "shadow", "retired"],
    "degraded": ["probing", "healthy", "quarantined", "blocked", "recertifying", "retired"],
    "quarantined": ["probing", "recertifying", "blocked", "retired"],
    "recertifying": ["shadow", "quarantined", "blocked", "retired"],
    "shadow": ["healthy", "quarantined", "blocked", "retired"],
    "blocked": ["probing", "recertifying", "quarantined", "retired"],
    "retired": [],
}
#: Failures in a row from which a route is quarantined.
MOST_FAILURES = 2


def decided(retired: Column, blocked: Column, hard: Column, failures: Column, signal: Column) -> Column:
    """The state after an observation, by the first that holds: retired stays; blocked; a hard failure or MOST_FAILURES in
    a row; signals; else healthy. One failure alone does not degrade a route."""
    return (
        F.when(retired, F.lit("retired")).when(blocked, F.lit("blocked")).when(hard | (failures >= MOST_FAILURES), F.lit("quarantined"))
        .when(signal, F.lit("degraded")).otherwise(F.lit("healthy"))
    )


def next_state(observations: DataFrame, keys: list[str], order: list, failed: Column, signal: Column, hard: Column | None = None, blocked: Column | None = None, retired: Column | None = None) -> DataFrame:
    """Each observation's run of failures so far and the state it leads to. A route that was retired once stays so.

    A run is what lies since the last success: the number of successes so far names it, so windows do and no row waits
    for another.
    """
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    no = F.lit(False)
    flags = {"__failed": failed, "__signal": signal, "__hard": no if hard is None else hard, "__blocked": no if blocked is None else blocked, "__retired": no if retired is None else retired}
    rows = observations.withColumns({k: F.coalesce(v, no) for k, v in flags.items()})
    rows = rows.withColumns({"__run": F.sum((~F.col("__failed")).cast("int")).over(so_far), "__gone": F.max("__retired").over(so_far)})
    in_run = Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failures", F.sum(F.col("__failed").cast("int")).over(in_run))
    state = decided(F.col("__gone"), F.col("__blocked"), F.col("__hard"), F.col("failures"), F.col("__signal"))
    return rows.withColumn("state", state).drop(*flags, "__run", "__gone")


def edges(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in ALLOWED.items() for b in [*to, a]], "from_state string, to_state string")


def invalid_steps(states: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Steps between neighbouring states that are not allowed. The table of edges has 50 rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    steps = states.withColumn("from_state", F.coalesce(F.lag("state").over(w), F.lit("probing"))).withColumn("to_state", F.col("state"))
    return steps.join(F.broadcast(edges(states.sparkSession)), ["from_state", "to_state"], "left_anti")


def after(state: str, failures: int, signal: bool, hard: bool, blocked: bool, retired: bool) -> str:
    """The rule of decided(), for one row."""
    if state == "retired" or retired:
        return "retired"
    if blocked:
        return "blocked"
    if hard or failures >= MOST_FAILURES:
        return "quarantined"
    return "degraded" if signal else "healthy"


class HealthProcessor(StatefulProcessor):
    """Keeps each key's run of failures and state; gives a row for every change of state.

    Rows of a key are taken in order of ts and event_id within a micro-batch, chunk by chunk: a row that is older than one
    seen before counts where it arrives.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "failures int, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, state = self.kept.get() if self.kept.exists() else (0, "probing")
        for chunk in rows:
            out = []
            for row in chunk.sort_values(["ts", "event_id"]).itertuples():
                failures = failures + 1 if row.failed else 0
                new = after(state, failures, row.signal, row.hard, row.blocked, row.retired)
                if new != state:
                    out.append((key[0], row.event_id, state, new))
                state = new
            yield pd.DataFrame(out, columns=["key", "event_id", "from_state", "to_state"])
        self.kept.update((failures, state))

    def close(self) -> None:
        pass


class OrderedHealthProcessor(StatefulProcessor):
    """As HealthProcessor, but in order of event time: rows are held until the watermark has passed them and then taken in
    order of ts and event_id, so that a late row, within the delay, counts where it belongs.

    Each row's time has a timer; a timer takes all held rows up to its time. What a key holds is what the delay spans.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "failures int, state string")
        self.held = handle.getListState("held", "ms long, event_id long, failed boolean, signal boolean, hard boolean, blocked boolean, retired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            times = (chunk["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            self.held.appendList([(ms, int(r.event_id), bool(r.failed), bool(r.signal), bool(r.hard), bool(r.blocked), bool(r.retired)) for ms, r in zip(times, chunk.itertuples(), strict=True)])
            for ms in set(times):
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(tuple(r) for r in self.held.get())
        failures, state = self.kept.get() if self.kept.exists() else (0, "probing")
        out = []
        for _, event_id, *flags in (r for r in rows if r[0] <= upto):
            failed, signal, hard, blocked, retired = flags
            failures = failures + 1 if failed else 0
            new = after(state, failures, signal, hard, blocked, retired)
            if new != state:
                out.append((key[0], event_id, state, new))
            state = new
        later = [r for r in rows if r[0] > upto]
        if later:
            self.held.put(later)
        else:
            self.held.clear()
        self.kept.update((failures, state))
        yield pd.DataFrame(out, columns=["key", "event_id", "from_state", "to_state"])

    def close(self) -> None:
        pass


def ordered_changes(events: DataFrame, key: str, delay: str) -> DataFrame:
    """A stream of changes of state as from stream_changes, of rows in order of event time: each is taken once the watermark, which
    lies `delay` behind the latest row, has passed it. Rows later than that are dropped. It equals next_state over the rows
    that the watermark has passed, whatever the order in which they came."""
    for name in ("hard", "blocked", "retired"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(False))
    rows = events.withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(OrderedHealthProcessor(), "key long, event_id long, from_state string, to_state string", "Append", "EventTime")


def stream_changes(events: DataFrame, key: str) -> DataFrame:
    """A stream of changes of state from a stream (key, event_id, ts, failed, signal, hard, blocked, retired); the last
    three may be missing. Needs a state store for several columns (RocksDB)."""
    for name in ("hard", "blocked", "retired"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(False))
    return events.groupBy(key).transformWithStateInPandas(HealthProcessor(), "key long, event_id long, from_state string, to_state string", "Append", "None")


def latest(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """A stream of counts and failures a key and hour; rows later than the delay are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), key).agg(F.count("*").alias("rows"), F.count_if("failed").alias("failures"))
