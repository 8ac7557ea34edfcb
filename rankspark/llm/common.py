"""Helpers shared by the operators: shared-storage tables, graph components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.session import BATCH_BYTES, map_arrow, prepare, scratch_path  # noqa: F401 (for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name (dots and back-ticks included)."""
    return F.col("`" + column.replace("`", "``") + "`")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """Hint a side whose measured size passed its bound; else leave the join to Spark."""
    return F.broadcast(df) if small else df


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) except the roots themselves.

    root = smallest node reachable. Alternating large-star and small-star
    rounds (each a join with per-node minima) until the edge set stays the
    same: O(log n) rounds in practice, and an edge set that never grows. The
    minima are dealt out on their own before the join so that Spark can split
    a hub's partition (adaptive skew join).
    """
    cur = written(edges.filter(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        mark = cur.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                       F.sum(F.hash("u", "v").cast("bigint")).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _spread(both.groupBy("u").agg(F.min("v").alias("m0"))
                      .select("u", F.least("u", "m0").alias("m")))
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(_spread(low), "u").filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = written(small, name)


def _spread(minima: DataFrame) -> DataFrame:
    return minima.repartition(F.xxhash64("u"))
