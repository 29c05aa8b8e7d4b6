"""Freshness: change events, their routing and debouncing, and progress, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

from ..functions import paths

#: Smoothing of progress rates: the newest sample's weight.
SMOOTHING = 0.25
#: Milliseconds without a change after which a file is indexed.
QUIET_MS = 500


def route(op: Column, is_dir: Column, is_config: Column, path: Column, rel: Column, exclude: list[str]) -> Column:
    """What an event asks for: 'reconcile' a root, index a 'file', or nothing (null)."""
    removed = op.isin("remove", "rename")
    changed = op.isin("create", "write")
    return (
        F.when(removed | is_config | ((op == "create") & is_dir), F.lit("reconcile"))
        .when(changed & ~is_dir & paths.supported(path) & ~paths.excluded(rel, exclude), F.lit("file"))
    )


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def debounced(events: DataFrame, key: str, ts: str, gap_seconds: int, *carried: str) -> DataFrame:
    """(key, first_ts, last_ts, events, carried...) of every burst: events no further apart than the gap.

    What is carried is from the burst's first event, which is the job that runs.
    Two events exactly the gap apart are one burst.
    """
    order = Window.partitionBy(key).orderBy(ts, *carried)
    apart = micros(F.col(ts)) - micros(F.lag(ts).over(order))
    begins = F.coalesce((apart > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.select(key, ts, *carried).withColumn("_begins", begins).withColumn("_burst", F.sum("_begins").over(order))
    first = F.min_by(F.struct(*carried), F.struct(ts, *carried)) if carried else F.lit(None)
    out = numbered.groupBy(key, "_burst").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), first.alias("_c"))
    return out.select(key, "first_ts", "last_ts", "events", *[F.col(f"_c.{c}").alias(c) for c in carried])


def debounced_stream(events: DataFrame, key: str, ts: str, gap: str, lateness: str, *carried: str) -> DataFrame:
    """The same for a stream: session windows behind a watermark."""
    first = F.min_by(F.struct(*carried), F.struct(ts, *carried)) if carried else F.lit(None)
    out = events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), first.alias("_c"))
    return out.select(key, "first_ts", "last_ts", "events", *[F.col(f"_c.{c}").alias(c) for c in carried])


def quiet_jobs(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(key, job) of a stream of (key, job): the first job of a key, once the key has been quiet for a while.

    Processing-time timers in Spark's keyed state; every event of the key sets the timer anew.
    """

    def step(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            (job,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "job": [job]})
            return
        for pdf in batches:
            if len(pdf) and not state.exists:
                state.update((pdf["job"].iloc[0],))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "job": pd.Series([], dtype=str)})

    return events.select("key", "job").groupBy("key").applyInPandasWithState(step, "key string, job string", "job string", "append", "ProcessingTimeTimeout")


class _Listing(SimpleDataSourceStreamReader):
    """Snapshots of a local folder, compared with the snapshot in the offset: new, rewritten and removed files."""

    def __init__(self, root: str):
        self.root = root

    def _now(self) -> dict[str, list[int]]:
        import os

        out = {}
        for d, dirs, names in os.walk(self.root):
            dirs[:] = sorted(x for x in dirs if not x.startswith("."))
            for n in sorted(names):
                try:
                    s = os.stat(f"{d}/{n}")
                except OSError:
                    continue
                out[f"{d}/{n}"] = [s.st_mtime_ns, s.st_size]
        return out

    def initialOffset(self):
        return {"files": {}}

    def read(self, start):
        before, now = start["files"], self._now()
        rows = [("remove", p, 0) for p in before if p not in now]
        rows += [("create" if p not in before else "write", p, s[1]) for p, s in now.items() if before.get(p) != s]
        return iter(rows), {"files": now}

    def readBetweenOffsets(self, start, end):
        before, now = start["files"], end["files"]
        rows = [("remove", p, 0) for p in before if p not in now]
        rows += [("create" if p not in before else "write", p, s[1]) for p, s in now.items() if before.get(p) != s]
        return iter(rows)

    def commit(self, end):
        pass


class FolderChanges(DataSource):
    """format("folder_changes"): a stream of (op, path, size); the built-in file stream sees neither rewritten nor removed files."""

    @classmethod
    def name(cls):
        return "folder_changes"

    def schema(self):
        return "op string, path string, size long"

    def simpleStreamReader(self, schema):
        return _Listing(self.options["path"])


def changes(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", root).load()


def keep_fresh(spark: SparkSession, root: str, checkpoint: str, index: Callable[[DataFrame], None], interval: str = "1 second"):
    """A running query that hands every batch of changes under root to index(); the checkpoint makes it resume."""
    return run(changes(spark, root), checkpoint, lambda df: None if df.isEmpty() else index(df), interval)


def run(stream: DataFrame, checkpoint: str, take: Callable[[DataFrame], None], interval: str = "1 second"):
    """A running query that hands every batch of a stream to take()."""
    return stream.writeStream.foreachBatch(lambda df, _: take(df)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def pending(query) -> int:
    """Jobs that wait in a running query over quiet_jobs(), or are being done by its present batch.

    A waiting job is a row of the query's state, so the number is right after a
    restart too. It is that of the last finished batch: jobs whose batch is
    still at work count.
    """
    progress = query.lastProgress
    return sum(s["numRowsTotal"] for s in progress["stateOperators"]) if progress else 0


def smoothed_rates(samples: DataFrame, key: str, ts: str, done: str) -> DataFrame:
    """(key, samples, rate) after a key's samples in order of ts: an exponential average of the units a second.

    The first interval's rate seeds it, as does any interval after a rate of 0;
    of samples at one time the one with the least done counts, and those
    without a time only add to the number of samples.

    Samples are dealt by (key, ts) into ranges, so that a key with most of them
    is spread over tasks. As long as no rate is negative a range maps the rate
    before it by a line, or from 0 to a value of its own; a second step takes
    the few ranges of a key in order. A range with a negative rate, after which
    the average may be 0, keeps its rates for that step.
    """
    t, d = micros(F.col(ts)).alias("t"), F.col(done).cast("double").alias("d")
    once = samples.select(key, t, d).groupBy(key, "t").agg(F.min("d").alias("d"), F.count("*").alias("n"))
    dealt = once.repartitionByRange(key, "t").withColumn("range", F.spark_partition_id())
    ranges = dealt.groupBy(key, "range").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "d")))).alias("s"))

    def rate(before, after):
        return (after["d"] - before["d"]) / ((after["t"] - before["t"]) / 1_000_000)

    def step(r, x):
        return F.when(r == 0, x).otherwise(SMOOTHING * x + (1 - SMOOTHING) * r)

    s, rates = F.col("s"), F.col("rates")
    inner = F.transform(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda x, i: rate(F.get(s, i), x))
    maps = ranges.withColumn("rates", inner).select(
        key,
        "n",
        F.get(s, F.lit(0)).alias("first"),
        F.get(s, F.size(s) - 1).alias("last"),
        F.aggregate(rates, F.lit(0.0), step).alias("of_zero"),
        F.aggregate(rates, F.lit(0.0), lambda r, x: SMOOTHING * x + (1 - SMOOTHING) * r).alias("add"),
        F.pow(F.lit(1 - SMOOTHING), F.size(rates)).alias("times"),
        F.when(F.exists(rates, lambda x: x < 0), rates).alias("rates"),
    )
    one = F.when(F.col("first").isNotNull(), F.struct("first", "last", "of_zero", "add", "times", "rates"))
    keys = maps.groupBy(key).agg(F.sum("n").alias("samples"), F.array_sort(F.collect_list(one)).alias("m"))

    def over(acc, x):
        r = F.when(acc["last"].isNull(), F.lit(0.0)).otherwise(step(acc["r"], rate(acc["last"], x["first"])))
        by_map = F.when(r == 0, x["of_zero"]).otherwise(x["add"] + x["times"] * r)
        return F.struct(x["last"].alias("last"), F.when(x["rates"].isNotNull(), F.aggregate(x["rates"], r, step)).otherwise(by_map).alias("r"))

    nothing = F.struct(F.lit(None).cast("struct<t:bigint,d:double>").alias("last"), F.lit(0.0).alias("r"))
    return keys.select(key, "samples", F.aggregate("m", nothing, over)["r"].alias("rate"))


def milestones(snapshots: DataFrame, key: str, ts: str, done: str, total: str, *ties: str) -> DataFrame:
    """The first snapshot of every tenth that a key passes; totals of 0 and null are passed over."""
    pct = F.floor(F.col(done) * 100 / F.col(total))
    rows = snapshots.where(F.col(total) > 0).withColumn("pct", pct.cast("long")).withColumn("tenth", F.floor(F.col("pct") / 10).cast("long"))
    so_far = F.max("tenth").over(Window.partitionBy(key).orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", F.coalesce(so_far, F.lit(-1))).where("tenth > _before").drop("_before")
