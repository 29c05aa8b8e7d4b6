"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Every source's documents form blocks of a fixed number of documents. A source
of weight u / period gives its i-th block (from 0) the release slot
floor(i * period / u) and the deadline ceil((i + 1) * period / u). Among the
released blocks the one with the earliest deadline takes the next slot; the
weights add up to one, so every slot is taken and, at any slot, what a source
has got differs from its share by less than one block. The schedule repeats
after `period` slots: one period is computed, in one row, and every block
finds its slot by a join on (source, index within the period). That row
holds the sources' distinct weights instead of the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, quoted, read

#: Slots in a period: weights are multiples of 1 / PERIOD. More sources than that get a longer period, of at least SPREAD slots a source.
PERIOD = 1024
SPREAD = 4
#: Picks that one array holds while the schedule is computed.
PICKS = 1024
#: Most sources whose schedule is broadcast.
BROADCAST = 1 << 14
#: Documents in a block.
BLOCK_DOCS = 16
#: Leading hexadecimal digits of the shuffling hash that divide a source into ranges.
RANGE_DIGITS = 3


def target_units(sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """Default targets: shares by the square root of a source's documents, in whole units.

    sources: (source, n). Every source has one unit; the rest goes by largest
    remainder, ties by source, so the units add up to the period. That is
    `period` for up to so many sources, and for more of them the next power of
    two at or above SPREAD slots a source.
    """
    every = Window.partitionBy()
    n = F.count("*").over(every)
    slots = F.when(n <= period, F.lit(period).cast("long")).otherwise(F.expr("shiftleft(1L, length(bin(_least - 1)))"))
    shares = sources.withColumn("_least", SPREAD * n).withColumn("left", slots - n)
    shares = shares.withColumn("exact", F.sqrt(F.col("n").cast("double")) / F.sum(F.sqrt(F.col("n").cast("double"))).over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.col("left"))
    shares = shares.withColumn("whole", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.col("whole"), 9))
    rank = F.row_number().over(every.orderBy(F.desc("rest"), "source"))
    short = F.col("left") - F.sum("whole").over(every)
    return shares.withColumn("rank", rank).withColumn("short", short).select("source", (1 + F.col("whole") + (F.col("rank") <= F.col("short")).cast("long")).alias("units"))


def pfair_schedule(units: DataFrame) -> DataFrame:
    """One period's schedule: (source, nth, slot, units, period) from (source, units).

    Earliest deadline first among released blocks; ties go to more units, then
    to the source that sorts first. Sources of equal units have equal release
    slots and deadlines, so a slot goes to such a class and within it by
    (index, source). The one row holds the classes, at most the square root of
    twice the period; one row a slot leaves.
    """
    units = units.where("units > 0")
    members = units.withColumn("member", (F.row_number().over(Window.partitionBy("units").orderBy("source")) - 1).cast("long"))
    one = units.groupBy("units").agg(F.count("*").alias("m")).groupBy().agg(F.sort_array(F.collect_list(F.struct("units", "m")), False).alias("s"), F.sum(F.col("units") * F.col("m")).alias("period"))
    pick = """array_min(filter(transform(s, (x, i) -> if(((acc.c[i] div x.m) * period) div x.units <= t,
        named_struct('deadline', ((acc.c[i] div x.m + 1) * period + x.units - 1) div x.units, 'i', i), null)), x -> x is not null)).i"""
    # The picks are held in short arrays, as appending copies an array.
    run = f"""aggregate(sequence(0L, (period - 1) div {PICKS}), named_struct('c', transform(s, x -> 0L), 'runs', cast(array() as array<array<int>>)),
        (a, k) -> aggregate(sequence(k * {PICKS}, least((k + 1) * {PICKS}, period) - 1), named_struct('c', a.c, 'picks', cast(array() as array<int>)),
            (acc, t) -> aggregate(array({pick}), acc, (st, p) -> named_struct(
                'c', transform(st.c, (n, i) -> if(i = p, n + 1L, n)), 'picks', array_append(st.picks, p))),
            acc -> named_struct('c', acc.c, 'runs', array_append(a.runs, acc.picks))),
        a -> flatten(a.runs))"""
    slots = one.select("s", "period", F.posexplode(F.expr(run)).alias("slot", "i")).select(F.expr("s[i].units").alias("units"), F.expr("s[i].m").alias("m"), "period", F.col("slot").cast("long").alias("slot"))
    given = F.row_number().over(Window.partitionBy("units").orderBy("slot")) - 1
    slots = slots.withColumn("given", given.cast("long")).select("units", "period", "slot", F.expr("given % m").alias("member"), F.expr("given div m").alias("nth"))
    return members.join(slots, ["units", "member"]).select("source", "units", "period", "slot", "nth")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, period: int = PERIOD, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with block, slot and position: the place of every row in the mixture.

    docs needs doc_id and source; every other column is carried along, and a
    column of docs that has one of the new names is replaced. weights: whole
    units by source; without it the units of target_units, whose period grows
    with the number of sources. A source that
    weights doesn't name, a null source (mixed as '') among them, gets one
    unit, and the period grows to the sum of units.

    Within a source, rows are in the order of md5(doc_id), then doc_id, then a
    hash of all columns but maps; a null doc_id counts as ''. Equal rows take
    adjacent places. block counts a
    source's blocks from 0; slot is the block's place in the whole mixture;
    position is slot * block_docs + the row's place in the block. No row is
    dropped: once a source has run out its later slots stay empty, and up to
    then each source's blocks within the first n slots differ from n times its
    share by less than one. An empty table gives an empty result.

    A source with a third of all rows is ranked in ranges of its hash: rows
    are counted by (source, range) before any shuffle of rows, so a task sorts
    one range at a time and adds the counts of the ranges before it.
    """
    kept = [c for c in docs.columns if c.lower() not in ("block", "slot", "position")]
    p = "_mix"
    while any(c.lower().startswith(p) for c in kept):
        p = "_" + p
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    tie = F.xxhash64(*[quoted(f.name) for f in docs.schema.fields if f.name in kept and "map<" not in f.dataType.simpleString()])
    rows = docs.select(*[quoted(c) for c in kept], key.alias(f"{p}_key"), tie.alias(f"{p}_tie")).withColumn(f"{p}_source", F.coalesce("source", F.lit(""))).withColumn(f"{p}_range", F.substring(f"{p}_key", 1, RANGE_DIGITS))
    counts = docs.select(F.coalesce("source", F.lit("")).alias(f"{p}_source"), F.substring(key, 1, RANGE_DIGITS).alias(f"{p}_range")).groupBy(f"{p}_source", f"{p}_range").agg(F.count("*").alias(f"{p}_n"))
    by_source = counts.groupBy(F.col(f"{p}_source").alias("source")).agg(F.sum(f"{p}_n").alias("n"))
    if weights is None:
        units = target_units(by_source, period)
    else:
        named = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(int(v)).cast("long"))]) if weights else F.lit(None).cast("map<string,bigint>")
        units = by_source.select("source", F.coalesce(named[F.col("source")], F.lit(1).cast("long")).alias("units"))
    n_sources = docs.select(F.coalesce("source", F.lit(""))).distinct().count()
    plan = cut(pfair_schedule(units))
    shares = plan.select(F.col("source").alias(f"{p}_source"), F.col("nth").alias(f"{p}_nth"), F.col("slot").alias(f"{p}_slot"), F.col("units").alias(f"{p}_units"), F.col("period").alias(f"{p}_period"))
    sizes = shares.select(f"{p}_source", f"{p}_units", f"{p}_period").distinct()
    by_nth = shares.select(f"{p}_source", f"{p}_nth", f"{p}_slot")
    before = F.sum(f"{p}_n").over(Window.partitionBy(f"{p}_source").orderBy(f"{p}_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(f"{p}_source", f"{p}_range", F.coalesce(before, F.lit(0).cast("long")).alias(f"{p}_before"))
    if n_sources > BROADCAST:
        # Units go along with the ranges' counts, so that no join of rows is by source alone.
        offsets = offsets.join(sizes, f"{p}_source")
    rank = F.row_number().over(Window.partitionBy(f"{p}_source", f"{p}_range").orderBy(f"{p}_key", "doc_id", f"{p}_tie"))
    placed = rows.withColumn(f"{p}_rank", rank).join(offsets, [f"{p}_source", f"{p}_range"])
    placed = placed.withColumn(f"{p}_at", F.col(f"{p}_before") + F.col(f"{p}_rank") - 1).withColumn(f"{p}_block", F.expr(f"{p}_at div {block_docs}"))
    if n_sources <= BROADCAST:
        # One row a source and one a slot of the period.
        placed, by_nth = placed.join(F.broadcast(sizes), f"{p}_source"), F.broadcast(by_nth)
    placed = placed.withColumn(f"{p}_nth", F.expr(f"{p}_block % {p}_units"))
    placed = placed.join(by_nth, [f"{p}_source", f"{p}_nth"])
    slot = F.expr(f"({p}_block div {p}_units) * {p}_period + {p}_slot")
    return placed.select(*[quoted(c) for c in kept], F.col(f"{p}_block").alias("block"), slot.alias("slot"), (slot * block_docs + F.expr(f"{p}_at % {block_docs}")).alias("position"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture by square-root targets: doc_id, source, block, slot, position."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source"))


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
e AS (SELECT s, sqrt(CAST(n AS DOUBLE)) / (SELECT sum(x ORDER BY s) FROM (SELECT s, sqrt(CAST(n AS DOUBLE)) AS x FROM n)) * ({PERIOD} - (SELECT count(*) FROM n)) AS exact FROM n),
f AS (SELECT s, exact, CAST(floor(exact) AS BIGINT) AS whole, round(exact - floor(exact), 9) AS rest FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, s) AS rank FROM f),
u AS (SELECT *, row_number() OVER (ORDER BY units DESC, s) AS i FROM (
  SELECT s, CAST(1 + whole + CASE WHEN rank <= {PERIOD} - (SELECT count(*) FROM f) - (SELECT sum(whole) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS units FROM r)),
l AS (SELECT list(units ORDER BY i) AS us, list(s ORDER BY i) AS ss FROM u),
run AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(us, lambda x: CAST(0 AS BIGINT)) AS c, us FROM l
  UNION ALL
  SELECT t + 1, p, list_transform(generate_series(1, len(us)), lambda i: CASE WHEN i = p THEN c[i] + 1 ELSE c[i] END), us
  FROM (SELECT t, c, us, list_min(list_transform(list_filter(generate_series(1, len(us)), lambda i: (c[i] * {PERIOD}) // us[i] <= t + 1),
          lambda i: (((c[i] + 1) * {PERIOD} + us[i] - 1) // us[i]) * 1000000 + i)) % 1000000 AS p FROM run WHERE t < {PERIOD} - 1)),
plan AS (SELECT u.s, u.units, run.t AS slot, row_number() OVER (PARTITION BY u.s ORDER BY run.t) - 1 AS nth FROM run JOIN u ON u.i = run.pick WHERE run.t >= 0),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS nr FROM d),
b AS (SELECT p.*, p.nr // {BLOCK_DOCS} AS block, u.units FROM p JOIN u USING (s))
SELECT b.doc_id, b.source, CAST(b.block AS BIGINT) AS block,
       CAST((b.block // b.units) * {PERIOD} + plan.slot AS BIGINT) AS slot,
       CAST(((b.block // b.units) * {PERIOD} + plan.slot) * {BLOCK_DOCS} + b.nr % {BLOCK_DOCS} AS BIGINT) AS position
FROM b JOIN plan ON plan.s = b.s AND plan.nth = b.block % b.units
"""
