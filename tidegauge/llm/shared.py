"""Lineage cuts, skew-safe joins and connected components shared by the operators.

Tables that cut lineage go to the folder the session names in
``spark.checkpoint.dir``; a folder of our own is made only when that is unset
and driver and executors are one process, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int | None):
    """While a job runs, at most so many rows go to Python at once: rows of several KB would else make batches of 100 MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if most is not None:
        spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pass_through(docs: DataFrame, result: tuple[str, ...] = ()) -> list:
    """The columns of ``docs`` in one struct, ``doc``, without those that ``result`` names: inside it no name can clash."""
    return [F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c not in result]).alias("doc")]


def restored(docs: DataFrame, result: tuple[str, ...] = ()) -> list:
    """The columns that :func:`pass_through` packed."""
    return [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in result]


def dealt_join(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, pieces: int = 1_024) -> DataFrame:
    """``rows`` with the columns of their group (one row a ``key``), without the largest groups landing in one task.

    ``size`` is a group's number of rows.  A group with more than one of
    ``pieces`` parts of all rows is dealt by a hash of ``spread``; there are fewer
    than ``pieces`` such groups at any scale, so their list is fit to be broadcast.
    """
    total = groups.agg(F.sum(size)).first()[0] or 1
    hot = groups.where(F.col(size) * pieces > total).select(key, F.ceil(F.col(size) * pieces / F.lit(total)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = groups.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system (metadata work on the driver)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether no node of ``edges(u, v)`` points to two others or both points and is pointed to."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return per.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).limit(1).count() == 0


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    ``edges`` has columns ``a`` and ``b`` (long).  Returns ``node`` and
    ``component`` (the smallest node reachable), one row per node that has an
    edge to another node; self loops and nulls are ignored and an empty input
    gives an empty result.  Every round is a group-by-minimum and a join back,
    so no neighbour list is ever collected; a hub's rows are split by adaptive
    skew joins.  Rounds end when every node points to one root and no root
    points on.  Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    e = written(e, "cc")
    for _ in range(max_rounds):
        if _is_forest_of_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        e = written(small, "cc")
    else:
        raise RuntimeError("connected components did not settle; raise max_rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
