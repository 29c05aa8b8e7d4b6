"""Mailboxes by byte ranges: files of any size, split among tasks at line ends.

Spark's text source deals a file's ranges out. A task cuts its lines at those
that begin a message; what a range has before its first one continues the last
message of the ranges before it. Counts of messages a range give every message
its number in the file. Only the last message of a range, and such beginnings,
are shuffled, to be put together.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .extract import MAIL_LINE, message_text

_QUOTED = re.compile(rb"^>(>*From )")


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(path, range, k, body, long): the k-th message of a range of a file, 0 for what goes before its first; long: a line is too long.

    A range has a last row without a body, whose k is the number of its messages.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"))

    def work(batches):
        here, k, held, long, out = None, 0, [], False, []

        def close(last: bool):
            if here is not None and (held or k):
                out.append((*here, k, b"\n".join(held), long))
            if here is not None and last:
                out.append((*here, k, None, False))

        def batch():
            columns = zip(*out, strict=True)
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "range", "k", "body", "long"])

        for b in batches:
            paths, ranges = b.column(1).to_pylist(), b.column(2).to_pylist()
            for line, at in zip(b.column(0).to_pylist(), zip(paths, ranges, strict=True), strict=True):
                if at != here:
                    close(True)
                    here, k, held, long = at, 0, [], False
                if line.startswith(b"From "):
                    close(False)
                    k, held, long = k + 1, [], len(line) > MAIL_LINE
                else:
                    long = long or len(line) > MAIL_LINE
                    held.append(b"" if long else _QUOTED.sub(rb"\1", line))
            if len(out) >= 1000:
                yield batch()
                out.clear()
        close(True)
        if out:
            yield batch()

    return lines.mapInArrow(work, "path string, range long, k long, body binary, long boolean")


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text, error) of the messages of mailboxes, by their numbers from 1; messages without text are left out.

    path: whatever Spark's text source reads. A file whose first line doesn't
    begin a message, or that has a line of over MAIL_LINE bytes, is one row with an
    error. Lines end with a line feed. The fragments are kept on the executors'
    disks, as they are used three times, until the session's cache is cleared.
    """
    parts = fragments(spark, path).persist(StorageLevel.DISK_ONLY)
    own = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.where("body is null").select("path", "range", F.col("k").alias("n"), F.coalesce(F.sum("k").over(own), F.lit(0)).alias("before"))
    broken = parts.where("body is not null").join(counts, ["path", "range"]).groupBy("path").agg(
        F.max("long").alias("long"), F.max((F.col("before") == 0) & (F.col("k") == 0)).alias("headless"))
    error = F.when(F.col("headless"), "the first line doesn't begin a message").when(F.col("long"), "a line is too long")
    broken = broken.select("path", error.alias("error")).where("error is not null")
    rows = parts.where("body is not null").join(counts, ["path", "range"]).select("path", "range", "k", "n", (F.col("before") + F.col("k")).alias("page"), "body")
    whole = rows.where("k > 0 and k < n").select("path", "page", "body")
    pieces = rows.where("k = 0 or k = n").groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("range", "body"))).alias("p"))
    joined = pieces.select("path", "page", F.expr("aggregate(p, cast(null as binary), (acc, x) -> if(acc is null, x.body, concat(acc, cast('\\n' as binary), x.body)))").alias("body"))
    good = whole.unionByName(joined).join(broken.select("path"), "path", "left_anti")

    def work(batches):
        for b in batches:
            texts = [message_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["path", "page", "text"])

    read = good.select("path", F.col("page").cast("int").alias("page"), "body").mapInArrow(work, "path string, page int, text string").where("text <> ''")
    return read.withColumn("error", F.lit(None).cast("string")).unionByName(broken.select("path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "error"))
