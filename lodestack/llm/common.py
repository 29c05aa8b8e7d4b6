"""What the training-data operators share: tables, lineage cuts, components, unique names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where neither the setting nor the context has one, a local session (tests)
    gets a temporary folder; on a cluster, which has to name a shared one, that
    is a RuntimeError.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all machines share")
    made = tempfile.mkdtemp(prefix="lodestack-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint, so that a lost executor costs one stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Has the files of a finished query's shuffles removed.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, *by: str) -> str:
    """A new folder below the shared one that holds the rows of df as Parquet, in folders by the columns `by`.

    The files of the shuffles behind df go when the write ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return folder


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, work, schema: T.StructType) -> DataFrame:
    """mapInArrow over all columns of df by position, whatever their names: Spark's own can't take dots in them.

    work sees columns c0, c1, ... and must return columns named likewise; the
    result has the names of schema.
    """
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(work, plain).toDF(*schema.names)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges (a, b), both of one orderable type.

    Returns (node, component) for every node that has an edge to another node;
    component is the smallest node that can be reached. Null ends and loops are
    ignored; an empty input gives an empty result.

    Each round hooks every node to the smallest node beside it, follows two
    such hooks, and contracts the edges; the nodes that still have edges at
    least halve, so the number of rounds is logarithmic. All work is joins and
    map-side combined minima: a node with a third of all edges costs one
    aggregated row a task, and its single row on a join's build side. Only a
    count of the remaining edges reaches the driver.
    """
    pairs = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    for _ in range(max_rounds):
        if pairs.isEmpty():
            break
        both = pairs.union(pairs.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up"))
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        hooks = cut(hooks.join(above, "up").select("node", "up", "upper"))
        first = hooks.select(F.col("node").alias("a"), F.col("upper").alias("ha"))
        second = hooks.select(F.col("node").alias("b"), F.col("upper").alias("hb"))
        moved = pairs.join(first, "a").join(second, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
        # Two hooks up may stop short of the root: the hook that is left over stays as an edge.
        chains = hooks.where("up <> upper").select(F.col("upper").alias("node")).distinct().join(hooks, "node")
        moved = moved.union(chains.select(F.col("node").alias("a"), F.col("upper").alias("b"))).where("a <> b")
        step = hooks.select("node", F.col("upper").alias("component"))
        if labels is None:
            labels = step
        else:
            nxt = step.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            labels = labels.join(nxt, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
        labels = cut(labels)
        pairs = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components: no end within max_rounds")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
