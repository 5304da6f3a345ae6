"""Streams return what batches return."""

import datetime as dt
import json
import os
import random

import duckdb
from pyspark.sql import functions as F

from paperloom import plans
from paperloom.sources.tables import Tables
from paperloom.streaming import jobs, timed

from .compare import assert_same


def arriving(spark, path, rows, schema):
    """Rows as a stream, a file a batch, in the given order."""
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/all/{i}")
        for name in sorted(os.listdir(f"{path}/all/{i}")):
            if name.endswith(".parquet"):
                os.makedirs(f"{path}/in", exist_ok=True)
                os.rename(f"{path}/all/{i}/{name}", f"{path}/in/{i:03d}.parquet")
                os.utime(f"{path}/in/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(spark, judged, path):
    """What a stream returns, and how many states it keeps after each batch."""
    for k, v in timed.STORE.items():
        spark.conf.set(k, v)
    stream = judged.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination()
    for k in timed.STORE:
        spark.conf.unset(k)
    return spark.read.schema(judged.schema).parquet(f"{path}/out"), [sum(s["customMetrics"].get("rocksdbTotalKeys", s["numRowsTotal"]) for s in p["stateOperators"]) for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, stream.recentProgress)]


START = dt.datetime(2024, 1, 1)
at = lambda minutes: START + dt.timedelta(minutes=minutes)


def test_a_lock_ends(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, good boolean"
    fails = [(i, 1, at(i), False) for i in range(3)]
    rows = [fails, [(3, 1, at(5), True), (4, 1, at(12), True), (5, None, at(12), False)], [(6, 1, at(13), True), (7, None, at(14), False), (8, 2, at(30), True)], [(9, 2, at(60), True)], [(10, 2, at(61), True)]]
    want = {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: True, 10: True}
    rule = timed.Lockout(3, 600)
    batch = timed.judged(spark.createDataFrame([r for b in rows for r in b], schema), "user_id", rule)
    assert {r.event_id: r.accepted for r in batch.where("kind = 'row'").collect()} == want
    assert [(r.user_id, r["at"]) for r in batch.where("kind = 'unlocked'").collect()] == [(1, (at(12) - dt.datetime(1970, 1, 1)).total_seconds())]
    out, _ = run(spark, timed.judged(arriving(spark, tmp_path, rows, schema), "user_id", rule), tmp_path)
    key = lambda r: (str(r.user_id), str(r.event_id), r["at"], r.kind, r.accepted)
    assert sorted(map(key, out.collect())) == sorted(map(key, batch.collect()))


def test_leases_expire_and_idle_buckets_go(spark, tmp_path):
    schema = "event_id long, job long, ts timestamp, worker string, action string"
    rows = [
        [(1, 1, at(0), "a", "claim"), (2, 1, at(1), "b", "claim"), (3, 1, at(8), "a", "heartbeat"), (4, 2, at(9), "a", "claim")],
        [(5, 1, at(17), "b", "claim"), (6, 1, at(17), "b", "heartbeat"), (7, 2, at(18), "a", "done"), (8, 2, at(18), "b", "claim")],
        [(9, 3, at(40), "c", "claim")], [(10, 1, at(41), "b", "claim"), (11, 3, at(41), "c", "done")], [(12, 4, at(100), "c", "done")], [(13, 4, at(101), "c", "done")],
    ]
    want = [(1, True), (2, False), (3, True), (4, True), (5, False), (6, False), (7, True), (8, True), (9, True), (10, True), (11, True), (12, False), (13, False)]
    rule = timed.Lease(600)
    batch = timed.judged(spark.createDataFrame([r for b in rows for r in b], schema), "job", rule)
    assert sorted((r.event_id, r.accepted) for r in batch.where("kind = 'row'").collect()) == want
    out, kept = run(spark, timed.judged(arriving(spark, tmp_path, rows, schema), "job", rule), tmp_path)
    assert sorted((r.event_id, r.accepted) for r in out.where("kind = 'row'").collect()) == want
    minutes = lambda d: sorted((r.job, round((r["at"] - (START - dt.datetime(1970, 1, 1)).total_seconds()) / 60)) for r in d.where("kind = 'expired'").collect())
    assert minutes(out) == [(1, 18), (1, 51), (2, 28)]  # also those that no later row of the job has met
    assert minutes(batch) == [(1, 18)]
    assert kept[-1] == 0  # whatever is over is forgotten


def test_token_bucket_stream_equals_batch(spark, folder, tmp_path):
    events = [tuple(r) for r in Tables(spark, folder).events.orderBy("ts", "event_id").select("event_id", "user_id", "ts").limit(300).collect()]
    rows, rule, schema = [events[i : i + 100] for i in range(0, 300, 100)], timed.TokenBucket(2, 1 / 3600), "event_id long, user_id long, ts timestamp"
    out, kept = run(spark, timed.judged(arriving(spark, tmp_path, rows, schema), "user_id", rule), tmp_path)
    batch = timed.judged(spark.createDataFrame(events, schema), "user_id", rule)
    assert sorted((r.event_id, r.accepted) for r in out.collect()) == sorted((r.event_id, r.accepted) for r in batch.collect())
    assert kept[-1] < max(kept)  # buckets that are full again are forgotten


def test_token_bucket_at_its_edges_is_that_of_the_sql(spark, tmp_path):
    """Whole minutes, so that many requests come just when a token is full."""
    draw, rows = random.Random(5), []
    for user in range(40):
        now = 0
        for _ in range(30):
            now += draw.choice([0, 10, 15, 20, 30, 40, 50, 60, 70, 120])
            rows.append((len(rows), user, at(now), "view", 1.0))
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert_same(plans.QUERIES["z03_token_bucket"](spark, str(tmp_path)), con, plans.SQL["z03_token_bucket"])


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(1, None, at(0)), (2, None, at(1)), (3, 2, at(0)), (4, 1 << 60, at(1))], "event_id long, user_id long, ts timestamp")
    out = timed.judged(df, "user_id", timed.TokenBucket(1, 1e-9)).collect()
    assert sorted((r.event_id, r.user_id, r.accepted) for r in out) == [(1, None, True), (2, None, False), (3, 2, True), (4, 1 << 60, True)]
    assert timed.judged(df.limit(0), "user_id", timed.TokenBucket(1, 1)).count() == 0


def test_repeats_within_the_watermark_go(spark, folder):
    events = Tables(spark, folder).events
    assert jobs.distinct_jobs(events.union(events), ["event_id"]).count() == events.select("event_id").distinct().count()


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).withColumn("k", F.col("id") % 2)
    jobs.replace_partitions(rows, path, "k")
    jobs.replace_partitions(rows.where("k = 1 AND id < 3"), path, "k")
    jobs.replace_partitions(rows.where("k = 1 AND id < 3"), path, "k")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 4, 6, 8]
