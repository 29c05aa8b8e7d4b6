"""Change streams, debouncing and progress."""

import time

from pyspark.sql import functions as F

from lodestack.streaming import watch


def drain(query, done, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not done():
        time.sleep(0.3)
    query.stop()
    assert done()


def test_folder_changes(spark, tmp_path):
    root, seen = tmp_path / "root", []
    root.mkdir()
    (root / "a.txt").write_text("one")
    query = watch.keep_fresh(spark, str(root), str(tmp_path / "checkpoint"), lambda df: seen.extend((r["op"], r["path"].rsplit("/", 1)[-1]) for r in df.collect()), "200 milliseconds")
    end = time.time() + 30
    while ("create", "a.txt") not in seen and time.time() < end:
        time.sleep(0.2)
    (root / "a.txt").write_text("changed")
    (root / "b.txt").write_text("two")
    while ("create", "b.txt") not in seen and time.time() < end + 30:
        time.sleep(0.2)
    (root / "b.txt").unlink()
    drain(query, lambda: ("remove", "b.txt") in seen)
    assert ("write", "a.txt") in seen


def test_quiet_jobs(spark, tmp_path):
    spark.createDataFrame([("k", "file"), ("k", "reconcile"), ("j", "file")], "key string, job string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("key string, job string").parquet(str(tmp_path / "in"))
    query = watch.quiet_jobs(events, 300).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    drain(query, lambda: spark.table("quiet").count() == 2)
    got = {r["key"]: r["job"] for r in spark.table("quiet").collect()}
    assert got["j"] == "file"
    assert got["k"] in ("file", "reconcile")


def test_bursts_in_batch_and_stream_agree(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:10:00", 2), ("a", "2024-01-01 00:20:01", 3), ("b", "2024-01-01 00:00:00", 4), ("a", "2024-01-02 00:00:00", 5)]
    df = spark.createDataFrame(rows, "k string, t string, n int").withColumn("t", F.col("t").cast("timestamp"))
    batch = sorted((r["k"], r["events"], r["n"]) for r in watch.debounced(df, "k", "t", 600, "n").collect())
    assert batch == [("a", 1, 3), ("a", 1, 5), ("a", 2, 1), ("b", 1, 4)]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = watch.debounced_stream(stream, "k", "t", "10 minutes 1 microsecond", "1 minute", "n").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["k"], r["events"], r["n"]) for r in spark.table("bursts").collect())
    assert got == [("a", 1, 3), ("a", 2, 1), ("b", 1, 4)]  # the last burst is still open


def test_rates(spark):
    rows = [("p", 0, 0), ("p", 10, 10), ("p", 10, 15), ("p", 20, 40)]
    df = spark.createDataFrame(rows, "k string, t long, d long").withColumn("t", F.timestamp_seconds("t"))
    (row,) = watch.smoothed_rates(df, "k", "t", "d").collect()
    assert abs(row["rate"] - (0.25 * 3 + 0.75 * 1)) < 1e-9


def test_milestones(spark):
    df = spark.createDataFrame([("p", n, n, 20) for n in range(1, 21)] + [("q", 1, 5, 0)], "k string, t int, d long, total long")
    got = [(r["tenth"], r["pct"]) for r in watch.milestones(df, "k", "t", "d", "total").orderBy("t").collect()]
    assert got == [(0, 5), *[(n, 10 * n) for n in range(1, 11)]]


def test_rates_of_a_split_key(spark):
    """A key with most samples lies in several ranges; negative rates and repeated times are as in a plain loop."""
    import random
    from datetime import datetime, timedelta, timezone

    rng, rows = random.Random(3), []
    for key, n, falls in (("hot", 3000, False), ("falls", 400, True), ("one", 1, False), ("zero", 5, False)):
        done = 0
        for i in range(n):
            done += 0 if key == "zero" else rng.choice([1, 2, -3]) if falls else rng.randint(0, 4)
            rows.append((key, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=i - i % 2 if i % 7 == 0 else i), float(done)))
    rows += [("cancel", datetime(2024, 1, 1, 0, 0, s, tzinfo=timezone.utc), d) for s, d in ((0, 0.0), (1, 1.0), (2, -2.0), (3, 5.0), (4, 6.0))] + [("hot", None, 1.0)]

    def plain(samples):
        t, d, r = None, None, 0.0
        for when, x in sorted(samples):
            if t is not None and when > t:
                rate = (x - d) / (when - t).total_seconds()
                r = rate if r == 0 else watch.SMOOTHING * rate + (1 - watch.SMOOTHING) * r
            if t is None or when > t:
                t, d = when, x
        return r

    df = spark.createDataFrame(rows, "key string, ts timestamp, done double").repartition(5)
    got = {r["key"]: r for r in watch.smoothed_rates(df, "key", "ts", "done").collect()}
    for key in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == key]
        assert got[key]["samples"] == len(own)
        assert abs(got[key]["rate"] - plain([x for x in own if x[0]])) < 1e-9
    ranges = df.repartitionByRange(4, "key", "ts").select("key", F.spark_partition_id().alias("p")).where("key = 'hot'").distinct().count()
    assert ranges > 1
