"""Helpers the text operators share: inputs, written intermediate tables and connected components."""
from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

BATCH_ROWS = "256"          # rows of one Arrow batch; long texts make wide batches


def prepared(spark: SparkSession) -> SparkSession:
    """Settings the operators assume: adaptive plans and Arrow batches that stay small with long texts."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back; survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark deletes them once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b: long); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows two pointers, and contracts the edges; what is left
    shrinks by a factor each round, also for chains. Only a yes/no reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(both.where("a <> b").distinct())
    labels = left.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while not left.isEmpty():
        hook = left.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hook = written(hook.join(up, "p").select("a", F.col("pp").alias("p")))
        labels = written(labels.join(hook.withColumnRenamed("a", "component"), "component", "left")
                         .select("node", F.coalesce("p", "component").alias("component")))
        ends = left.join(hook, "a").select(F.col("p").alias("a"), "b")
        ends = ends.join(hook.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b").select("a", F.col("pb").alias("b"))
        left = written(ends.where("a <> b").distinct())
    return labels
