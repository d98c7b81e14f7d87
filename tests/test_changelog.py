"""Keyed change logs: newest versions, replays, what a batch writes, compaction; settling over several batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from blockwalk.sources.changelog import KeyedLog, changed_rows
from blockwalk.streaming import changes, sinks

ROWS = "id long, data string, n int"


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_versions_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    log = KeyedLog(spark, path, ["id"]).create(spark.createDataFrame([(i, "first", i) for i in range(400)], ROWS), bucket_rows=20)
    want, pick = {i: ("first", i) for i in range(400)}, random.Random(1)
    base = files(f"{path}/base")
    assert len(base) == 20
    for batch in range(6):
        keys = sorted({pick.choice([3, 7, 11, 3]) for _ in range(3)}) + ([500 + batch] if batch == 4 else [])
        rows = [(k, f"b{batch}", None if k == 7 else k) for k in keys]
        for _ in range(2):  # written again, as after a failure
            log.append(spark.createDataFrame(rows, ROWS), batch)
        want |= {k: (d, n) for k, d, n in rows}
        written = files(f"{path}/log/batch={batch}")
        assert len(written) <= len(rows)  # no more files than buckets of its keys
    assert files(f"{path}/base") == base
    got = lambda df: {r["id"]: (r["data"], r["n"]) for r in df.collect()}
    assert got(log.read()) == want
    assert got(log.read(below=0)) == {i: ("first", i) for i in range(400)}
    assert got(log.lookup(spark.createDataFrame([(7,), (504,), (999,)], "id long"))) == {k: want[k] for k in (7, 504)}
    assert not got(log.lookup(spark.createDataFrame([(504,)], "id long"), below=4))
    buckets = log.compact(3)
    assert 1 <= len(buckets) <= 3
    after = files(f"{path}/base")
    kept = {p: t for p, t in base.items() if int(p.split("bucket=")[1].split("/")[0]) not in buckets}
    assert kept.items() <= after.items() and len(kept) == 20 - len(buckets)  # the others were not touched
    assert got(log.read()) == want
    assert log.compact(5) and got(log.read()) == want and log.compact(5) == []
    log.append(spark.createDataFrame([(3, "last", 0)], ROWS), 6)
    assert got(log.read())[3] == ("last", 0) and len(got(log.read())) == 401


def test_changed_rows(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2)], ROWS)
    new = spark.createDataFrame([(1, "a", None), (2, "b", 3), (3, None, None)], ROWS)
    assert sorted(r["id"] for r in changed_rows(old, new).collect()) == [2, 3]


def test_empty_tables(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "t"), ["id"]).create(spark.createDataFrame([], ROWS))
    assert log.read().count() == 0 and log.compact(0) == []
    log.append(spark.createDataFrame([(1, "a", 1)], ROWS), 1)
    assert log.read().count() == 1 and log.lookup(spark.createDataFrame([], "id long")).count() == 0


def test_settling_by_batches(spark, tmp_path, pieces=3):
    """Three tables settled from callbacks that arrive in any order and twice; the last batch once more."""
    order = lambda k: ["don_", "p", "live_", "lrg_"][k % 4] + str(k)
    pick = random.Random(pieces)
    calls = [(order(k), pick.choice([changes.SUCCESS, changes.FAILED, changes.DROPPED[0]]), 1_700_000_000 + i) for i, k in enumerate(pick.choices(range(60), k=150))]
    calls += calls[:40]
    df = spark.createDataFrame(calls, "order_id string, type string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    for k in range(pieces):
        part = calls[k * len(calls) // pieces:(k + 1) * len(calls) // pieces]
        spark.createDataFrame(part, "order_id string, type string, ts long").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make = lambda kind: [(k, order(k), order(k), "created") for k in range(60) if k % 4 in kind]
    schema = "id long, payment_id string, order_id string, payment_status string"
    start = {"donations": spark.createDataFrame(make([0]), schema).withColumn("is_paid", F.lit(None).cast("boolean")),
             "live_exports": spark.createDataFrame(make([2, 3]), schema).withColumn("regen_allowance", F.lit(1)).withColumnRenamed("id", "session_id"),
             "projects": spark.createDataFrame(make([1]), schema).withColumn("regen_allowance", F.lit(5))}
    tables = {n: KeyedLog(spark, f"{tmp_path}/{n}", ["order_id"]).create(t, bucket_rows=4) for n, t in start.items()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.settle_stream(stream, tables, f"{tmp_path}/checkpoint").awaitTermination()
    once = {n: sorted(map(tuple, t.read().collect()), key=str) for n, t in tables.items()}
    commits = sorted(int(c) for c in os.listdir(f"{tmp_path}/checkpoint/commits") if c.isdigit())
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    changes.settle_stream(stream, tables, f"{tmp_path}/checkpoint").awaitTermination()
    assert {n: sorted(map(tuple, t.read().collect()), key=str) for n, t in tables.items()} == once
    paid = {c[0] for c in calls if c[1] == changes.SUCCESS}
    live = {r["order_id"]: r for r in tables["live_exports"].read().collect()}
    for o, r in live.items():
        if o.startswith("live_"):
            assert (r["payment_status"], r["regen_allowance"]) == (("paid", 6) if o in paid else ("created", 1))
        else:
            assert (r["payment_id"], r["regen_allowance"]) == ((f"processed_{o}", 7) if o in paid else (o, 1))
    for r in tables["projects"].read().collect():
        assert (r["payment_status"], r["regen_allowance"]) == (("paid", 10) if r["order_id"] in paid else ("created", 5))
    assert {r["order_id"] for r in tables["donations"].read().collect() if r["is_paid"]} == {o for o in paid if o.startswith("don_")}


def test_saves_over_batches(spark, tmp_path):
    table = KeyedLog(spark, f"{tmp_path}/docs", ["id"]).create(spark.createDataFrame([(1, "one", 0), (2, "two", 0)], "id long, data string, updated_at long"))
    for k, rows in enumerate([[(1, "a", 5), (1, "b", 7), (3, "new", 1)], [(2, None, 9), (1, "c", 8)]]):
        spark.createDataFrame(rows, "id long, data string, updated_at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, data string, updated_at long").parquet(f"{tmp_path}/in")
        changes.save_documents(stream, table, f"{tmp_path}/checkpoint", interval=None).awaitTermination()
    assert {tuple(r) for r in table.read().select("id", "data", "updated_at").collect()} == {(1, "c", 8), (2, "two", 9), (3, "new", 1)}
    assert sinks.newest_rows(table.read(), "id", ["updated_at"]).count() == 3


def test_no_announcement_twice(spark, tmp_path):
    """Donations paid before the stream, paid in one batch and again much later, and paid after a refund; the last batch replayed."""
    schema = "id long, version long, is_paid boolean, name string, amount double, note string"
    log = KeyedLog(spark, f"{tmp_path}/paid", ["id"]).create(spark.createDataFrame([(1, True), (2, None), (3, False)], "id long, is_paid boolean"), bucket_rows=1)
    rows = [[(1, 0, True), (2, 0, True), (4, 0, None)], [(2, 1, True), (3, 1, False), (1, 1, False)], [(1, 2, True), (2, 2, True), (4, 1, True), (4, 2, True), (3, 2, None)]]
    for k, part in enumerate(rows):
        spark.createDataFrame([(*r, f"n{r[0]}", 5.0, None) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        changes.announce_stream(stream, log, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    read = lambda: sorted((r["id"], r["version"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert read() == [(1, 2), (2, 0), (4, 1)]
    for name in ("2", ".2.crc"):
        os.remove(f"{tmp_path}/checkpoint/commits/{name}")
    changes.announce_stream(stream, log, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert read() == [(1, 2), (2, 0), (4, 1)]
