"""Results by batch against results of everything at once."""

import os
import random

from pyspark.sql import functions as F

from paperloom.plans.catalogue import INVOICE, invoice_matches, maintained_invoices


def rows(rng, ids):
    pick = lambda kind, n: rng.choice([None, *[f"{kind}-{i}" for i in range(n)]])
    return [(i, pick("INV", 12), pick("PO", 8), rng.choice([None, 1, 2, 3]), rng.choice([None, 10, 20, 30])) for i in ids]


def frame(spark, data, deleted=()):
    df = spark.createDataFrame(data, "doc_id long, number string, po_number string, vendor_id long, total int")
    return df.withColumn("total", F.col("total").cast("decimal(18,4)")).withColumn("deleted", F.col("doc_id").isin(list(deleted)) if deleted else F.lit(None).cast("boolean"))


def whole(spark, state):
    df = frame(spark, list(state.values())).drop("deleted") if state else spark.createDataFrame([], INVOICE)
    return sorted(map(tuple, invoice_matches(df.select("doc_id"), df).collect()))


def test_batches_equal_the_whole(spark, tmp_path):
    rng, state = random.Random(4), {}
    kept = maintained_invoices(spark, str(tmp_path), 8)
    for batch in range(4):
        data = rows(rng, rng.sample(range(40), 15))
        deleted = {r[0] for r in data[:3]} if batch else set()
        kept.apply(frame(spark, data, deleted), batch)
        state = {k: v for k, v in (state | {r[0]: r for r in data}).items() if k not in deleted}
        assert sorted(map(tuple, kept.results().drop("batch").collect())) == whole(spark, state)
    before = sorted(map(tuple, kept.results().collect()))
    kept.apply(frame(spark, data, deleted), 3)  # once more: nothing changes
    assert sorted(map(tuple, kept.results().collect())) == before
    kept.apply(frame(spark, list(state.values()), set(state)), 4)  # all gone
    assert kept.results().count() == 0 and kept.read("keys").count() == 0


def test_untouched_partitions_are_not_rewritten(spark, tmp_path):
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    kept = maintained_invoices(spark, str(tmp_path), 64)
    data = [(i, f"INV-{i}", f"PO-{i // 2}", i, i) for i in range(60)]
    kept.apply(frame(spark, data), 0)
    first = files()
    kept.apply(frame(spark, [(100, "INV-100", "PO-3", 100, 100)]), 1)
    changed = {r.doc_id for r in kept.results().where("batch = 1").collect()}
    assert changed == {6, 7, 100} and {r.doc_id: r.billed for r in kept.results().where("batch = 1").collect()} == {6: 3, 7: 3, 100: 3}
    gone = first - files()
    assert 0 < len(gone) < len(first) / 4
    assert {os.path.basename(os.path.dirname(f)) for f in gone if "/results/" in f} <= {f"bucket={r.bucket}" for r in kept._in_bucket(kept.results().where("batch = 1"), "doc_id").collect()}


def test_a_stream_of_batches(spark, tmp_path):
    data = rows(random.Random(9), range(30))
    for i in range(3):
        frame(spark, data[i * 10 : i * 10 + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = maintained_invoices(spark, str(tmp_path / "kept"), 8)
    stream = spark.readStream.schema(frame(spark, data).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(kept.apply).start()
    run.awaitTermination()
    assert sorted(map(tuple, kept.results().drop("batch").collect())) == whole(spark, {r[0]: r for r in data})
    assert kept.results().select("batch").distinct().count() > 1
