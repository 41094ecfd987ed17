"""Connected components of an edge table, and the folder for what ends a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a full address: spark.checkpoint.dir.

    Where that is unset, local mode gets a temporary folder that goes at exit, and a cluster a folder of its own on
    its default filesystem. A cluster whose default filesystem is local has no shared folder: an error.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_delver_dir", None)
    path = sc._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
    conf = sc._jsc.hadoopConfiguration()
    if not there:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            there = tempfile.mkdtemp(prefix="delver-")
            atexit.register(shutil.rmtree, there, True)
            there = f"file://{there}"
        else:
            home = path("/").getFileSystem(conf).getHomeDirectory()
            if home.toUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            there = f"{home}/delver-{uuid.uuid4().hex}"
        sc._delver_dir = there  # type: ignore[attr-defined]
    full = path(there)
    full = full.getFileSystem(conf).makeQualified(full).toString()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(full)
    return full


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._delver_tables = [*getattr(spark.sparkContext, "_delver_tables", []), path]  # type: ignore[attr-defined]
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes every table that stored() wrote in this session; results that read one must have been consumed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in getattr(spark.sparkContext, "_delver_tables", []):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)  # type: ignore[union-attr]
        at.getFileSystem(conf).delete(at, True)
    spark.sparkContext._delver_tables = []  # type: ignore[attr-defined]


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that all executors share."""
    shared_dir(spark)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b).

    Every round hooks each node to its smallest neighbour, jumps pointers and contracts the edges, so
    the rounds are few; hub nodes are absorbed by partial aggregation.
    """
    spark = edges.sparkSession
    edges = cut(spark, edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct())
    names = cut(spark, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("at", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = cut(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")))
        for _ in range(2):
            up = up.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        up = cut(spark, up)
        names = cut(spark, names.join(up.withColumnRenamed("a", "at"), "at", "left").select("node", F.coalesce("b", "at").alias("at")))
        left, right = up.select("a", F.col("b").alias("x")), up.select(F.col("a").alias("b"), F.col("b").alias("y"))
        edges = cut(spark, edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return names.select("node", F.col("at").alias("component"))
