"""Stateful operators on keyed state with timers, in RocksDB: the rate limiter and the variants' history, both restartable.

State lives in the checkpoint, by key, and only what a trigger touches is read; it doesn't grow with what was ever seen, as
timers (limiter) and updates in place (history) bound it. After a restart from the checkpoint the answers go on as if
nothing had happened.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrymill.streaming.live import DAY, PER_DAY, PER_MINUTE, admit

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs; it holds for queries started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _seconds(times: pd.Series) -> list[float]:
    return (times.astype("datetime64[us]").astype("int64") / 1e6).tolist()


class Limiter(StatefulProcessor):
    """Allowed hits of a key's last day as a list; a timer a day behind the last of them clears it."""

    def __init__(self, key: str, ts: str, per_minute: int, per_day: int):
        self.key, self.ts, self.per_minute, self.per_day = key, ts, per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a trigger's rows come in several chunks, in no order
        times = sorted(t for pdf in rows for t in _seconds(pdf[self.ts]))
        hits = deque(row[0] for row in self.hits.get())
        before = hits[-1] if hits else None
        allowed = [admit(hits, t, self.per_minute, self.per_day) for t in times]
        if hits:
            self.hits.put([(h,) for h in hits])
            if hits[-1] != before:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int((hits[-1] + DAY) * 1000))
        yield pd.DataFrame({self.key: [key[0]] * len(times), "at": times, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        yield pd.DataFrame({self.key: [], "at": [], "allowed": []})

    def close(self) -> None:
        pass


def limit_rate_keyed(df: DataFrame, key: str, ts: str, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, late: str = "1 hour") -> DataFrame:
    """The limiter on a stream: key, at (seconds), allowed."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.withWatermark(ts, late).groupBy(key)
    return rows.transformWithStateInPandas(Limiter(key, ts, per_minute, per_day), f"{key} {kind}, at double, allowed boolean", "Append", "EventTime")


class Changes(StatefulProcessor):
    """The last state of a key; a row that differs from it goes to the history, a key's first one doesn't."""

    def __init__(self, key: list[str], state: list[str], types: str, at: str):
        self.key, self.state, self.types, self.at = key, state, types, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.types)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update(tuple(_plain(initialState[c].iloc[0]) for c in self.state))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        now = self.last.get() if self.last.exists() else None
        out = []
        for row in seen.to_dict("records"):
            fresh = tuple(_plain(row[c]) for c in self.state)
            if now is not None and tuple(now) != fresh:
                out.append((*key, *fresh, row[self.at]))
            now = fresh
        self.last.update(tuple(now))
        yield pd.DataFrame(out, columns=[*self.key, *self.state, self.at])

    def close(self) -> None:
        pass


def _plain(value):
    """A Python value of a cell, None for a missing one."""
    if value is None or (not isinstance(value, str) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def history_stream(df: DataFrame, key: list[str], state: list[str], at: str, known: DataFrame | None = None) -> DataFrame:
    """``key``, ``state``, ``at`` of every row of a stream that differs from the one before it of its key; ``known`` is the state that the stream begins with."""
    field = lambda c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    rows = df.select(*key, *state, at).groupBy(*key)
    start = None if known is None else known.select(*key, *state).groupBy(*key)
    processor = Changes(key, state, ", ".join(map(field, state)), at)
    return rows.transformWithStateInPandas(processor, ", ".join(map(field, [*key, *state, at])), "Append", "None", start)


def signups(df: DataFrame, address: str, ip: str, ts: str, per_minute: int = PER_MINUTE, per_day: int = PER_DAY) -> DataFrame:
    """One entry for sign-ups (a batch): their rows with email (trimmed, in lower case), status and is_new.

    A request beyond the limit of its ip is ``rate_limited``, one without a valid address ``invalid_email``, both are left
    out of the list; of the others (``ok``) the first of an address is new. A request that is limited counts for nothing,
    one with a bad address counts as a hit.
    """
    from pyspark.sql import Window

    from quarrymill.functions.scalars import valid_email
    from quarrymill.streaming.live import limit_rate

    rows = limit_rate(df, ip, ts, address, per_minute, per_day)
    email = F.lower(F.trim(F.col(address)))
    status = F.when(~F.col("allowed"), "rate_limited").when(~valid_email(email), "invalid_email").otherwise("ok")
    rows = rows.withColumn("email", email).withColumn("status", status).drop("allowed")
    first = F.row_number().over(Window.partitionBy("email", "status").orderBy(ts, ip)) == 1
    return rows.withColumn("is_new", (F.col("status") == "ok") & first)
