"""Stateful and windowed behaviour, in batch and in Structured Streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrymill.operators.maintain import snapshots, update_existing

PER_MINUTE, PER_DAY = 10, 30
MINUTE, DAY = 60.0, 86_400.0


def admit(hits: deque, at: float, per_minute: int = PER_MINUTE, per_day: int = PER_DAY) -> bool:
    """Whether a hit is allowed; ``hits`` holds the allowed ones of the last day, and a rejected hit isn't recorded."""
    while hits and at - hits[0] >= DAY:
        hits.popleft()
    if len(hits) >= per_day or sum(at - h < MINUTE for h in hits) >= per_minute:
        return False
    hits.append(at)
    return True


def limit_rate(df: DataFrame, key: str, ts: str, tie: str, per_minute: int = PER_MINUTE, per_day: int = PER_DAY) -> DataFrame:
    """``df`` with allowed. Decisions depend on earlier ones of the key, so a key's rows pass one task in order; state is at most ``per_day`` times a key, kept for one key at a time."""
    schema = df.schema.add("allowed", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hits = None, deque()
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[ts].astype("int64" if pdf[ts].dtype == "int64" else "datetime64[us]").astype("int64") / 1e6):
                if k != now:
                    now, hits = k, deque()
                out.append(admit(hits, t, per_minute, per_day))
            yield pdf.assign(allowed=out)

    return df.repartition(key).sortWithinPartitions(key, ts, tie).mapInPandas(run, schema)


def limit_rate_stream(df: DataFrame, key: str, ts: str, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, late: str = "1 hour") -> DataFrame:
    """The limiter on a stream: key, at (seconds), allowed; a key's state expires when the watermark is a day past its last hit."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0]) if state.exists else deque()
        # a trigger's rows of a key come in several chunks, in no order: their times are sorted together
        times = sorted(t for pdf in pdfs for t in (pdf[ts].astype("datetime64[us]").astype("int64") / 1e6).tolist())
        yield pd.DataFrame({key: [k[0]] * len(times), "at": times, "allowed": [admit(hits, t, per_minute, per_day) for t in times]})
        state.update((list(hits),))
        last = int((hits[-1] if hits else 0) * 1000 + DAY * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    kind = df.schema[key].dataType.simpleString()
    return df.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at double, allowed boolean", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the lateness."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def bucketed_stream(df: DataFrame, ts: str, width: str, late: str, *aggs) -> DataFrame:
    """Tumbling-window aggregates that close when the watermark passes."""
    from quarrymill.operators.telemetry import bucketed

    return bucketed(df.withWatermark(ts, late), ts, width, *aggs)


def latest_state(spark: SparkSession, state_path: str, before: int) -> DataFrame | None:
    """The state of the greatest version (folders ``version=N``) below ``before``; None if there is none."""
    versions = spark.read.parquet(state_path).where(F.col("version") < before).agg(F.max("version")).first()[0]
    return None if versions is None else spark.read.parquet(f"{state_path}/version={versions}")


def changes_to_history(new: DataFrame, batch: int, state_path: str, history_path: str, key: list[str], state: list[str], at: str) -> None:
    """A foreachBatch body: writes the changed states of a micro-batch to the history, and the next version of the state.

    Of a key's rows in the batch the last one by ``at`` counts. A key that the state lacks enters it without a history
    row. Version 0 is the state before the first batch; batch N reads the greatest version up to N and writes N + 1, and
    its history rows have a folder of their own, so a batch that is run again after a failure gives the same files.
    """
    old = latest_state(new.sparkSession, state_path, batch + 1)
    last = new.groupBy(*key).agg(F.max_by(F.struct(*state, at), F.struct(at, *state)).alias("__x")).select(*key, "__x.*")
    changed = snapshots(old, last.drop(at), key, state, F.lit(None)).drop("observed_at").join(last.select(*key, F.col(at).alias("observed_at")), key)
    changed.write.mode("overwrite").parquet(f"{history_path}/batch={batch}")
    fresh = last.select(*key, *state).join(old.select(*key), key, "left_anti")
    update_existing(old, last, key, state).unionByName(fresh, allowMissingColumns=True).write.mode("overwrite").parquet(f"{state_path}/version={batch + 1}")
