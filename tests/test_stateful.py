"""Keyed state in RocksDB: answers after a restart from the checkpoint, state that expires, history from a known state; sign-ups; the alert sink."""

import datetime as dt
import json
import random
from collections import deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import alerts
from quarrymill.streaming import live, stateful

D = dt.datetime(2024, 1, 1)


@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drain(df, tmp_path, name):
    """Runs the query over what is there and stops: the next call is a restart from its checkpoint."""
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c-{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_limiter_goes_on_after_a_restart(rocksdb, tmp_path):
    rng = random.Random(4)
    days = [sorted(rng.randrange(d * 86_400, (d + 1) * 86_400) for _ in range(60)) for d in range(3)]
    schema = "k string, ts timestamp"
    for times in days:
        rocksdb.createDataFrame([("a", D + dt.timedelta(seconds=t)) for t in times], schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        drain(stateful.limit_rate_keyed(rocksdb.readStream.schema(schema).parquet(f"{tmp_path}/in"), "k", "ts", 2, 20), tmp_path, "out")
    hits: deque = deque()
    base = D.replace(tzinfo=dt.timezone.utc).timestamp()
    want = [(base + t, live.admit(hits, base + t, 2, 20)) for t in sorted(sum(days, []))]
    got = sorted((r.at, r.allowed) for r in rocksdb.read.parquet(f"{tmp_path}/out").collect())
    assert got == want and 20 <= sum(ok for _, ok in got) < 100


def test_history_goes_on_after_a_restart(rocksdb, tmp_path):
    """The first row of a new key has no history, what a known key changes to has; equal rows have none; nulls are values."""
    schema = "store string, id int, price double, ok boolean, at timestamp"
    known = rocksdb.createDataFrame([("a", 1, 5.0, True), ("a", 2, None, False)], "store string, id int, price double, ok boolean")
    steps = [[("a", 1, 5.0, True, 0), ("a", 2, 6.0, False, 0), ("b", 1, 1.0, True, 0)], [("a", 1, 4.0, True, 2), ("a", 1, 5.0, True, 1), ("b", 1, 1.0, True, 1)], [("a", 1, 4.0, True, 3), ("b", 1, None, True, 3), ("a", 2, 6.0, True, 3)]]
    for rows in steps:
        rocksdb.createDataFrame([(*r[:-1], D + dt.timedelta(hours=r[-1])) for r in rows], schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rocksdb.readStream.schema(schema).parquet(f"{tmp_path}/in")
        drain(stateful.history_stream(stream, ["store", "id"], ["price", "ok"], "at", known), tmp_path, "out")
    got = sorted((r.store, r.id, r.price, r.ok, (r.at - D).seconds // 3600) for r in rocksdb.read.parquet(f"{tmp_path}/out").fillna({"price": -1.0}).collect())
    assert got == [("a", 1, 4.0, True, 2), ("a", 2, 6.0, False, 0), ("a", 2, 6.0, True, 3), ("b", 1, -1.0, True, 3)]


def test_signups(spark):
    rows = [(i, "x@y.co" if i % 2 else " X@Y.co ", "1", D + dt.timedelta(seconds=i)) for i in range(12)] + [(20, "no", "2", D), (21, "a@b.co", "2", D), (22, None, "3", D), (23, "a@b.co", "3", D + dt.timedelta(days=2))]
    got = {r.i: (r.status, r.is_new, r.email) for r in stateful.signups(spark.createDataFrame(rows, "i int, address string, ip string, ts timestamp"), "address", "ip", "ts").collect()}
    assert [got[i][0] for i in range(12)] == ["ok"] * 10 + ["rate_limited"] * 2 and [got[i][1] for i in range(3)] == [True, False, False]
    assert got[20][:2] == ("invalid_email", False) and got[21] == ("ok", True, "a@b.co") and got[22][0] == "invalid_email" and got[23][:2] == ("ok", False)


def test_alert_sink(spark, tmp_path):
    alerts.register(spark)
    rows = spark.createDataFrame([("store a: 60 of 100",), ("two\nlines",)], "message string").repartition(2)
    rows.write.format("alerts").option("path", f"file://{tmp_path}/log").mode("append").save()
    lines = [x for f in Path(tmp_path, "log").glob("*.log") for x in f.read_text().splitlines()]
    assert len(lines) == 2 and all(x.startswith("[") and "] ALERT " in x for x in lines) and any(x.endswith("two lines") for x in lines)
    assert not list(Path(tmp_path, "log").glob(".*-*"))  # no task's file is left
    # a message that can't be sent, and a folder that can't be made, are counted; the run goes on
    rows.write.format("alerts").option("path", f"{tmp_path}/web").option("webhook", "http://127.0.0.1:9/none").mode("append").save()
    told = json.loads(next(Path(tmp_path, "web").glob("*.json")).read_text())
    assert (told["lines"], told["failed"]) == (2, 2) and told["errors"]
    (tmp_path / "file").write_text("")
    rows.write.format("alerts").option("path", f"{tmp_path}/file/no").mode("append").save()
    # an aborted write leaves nothing
    bad = spark.range(0, 4, 1, 2).select(F.when(F.col("id") < 2, "x").otherwise(F.raise_error(F.lit("stop"))).alias("message"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("alerts").option("path", f"{tmp_path}/aborted").mode("append").save()
    assert not list(Path(tmp_path, "aborted").glob("*.log")) and not list(Path(tmp_path, "aborted").glob("*.json"))
