"""Transitive closure of edges by semi-naive iteration: only the last round's new pairs are joined on."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a loop's lineage stays short and survives lost executors."""
    path = f"{_shared(df.sparkSession).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", max_depth: int | None = None) -> DataFrame:
    """(child, parent, depth) of all pairs connected by a path, of up to ``max_depth`` edges if given, with the shortest depth.

    Cycles end, as a pair that is known is not followed again. Null ends are left out.
    """
    base = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).filter("child IS NOT NULL AND parent IS NOT NULL").distinct()
    base = materialize(base)
    known = base.withColumn("depth", F.lit(1))
    frontier = known
    for depth in count(2) if max_depth is None else range(2, max_depth + 1):
        step = frontier.alias("f").join(base.alias("e"), F.col("f.parent") == F.col("e.child")).select(F.col("f.child").alias("child"), F.col("e.parent").alias("parent")).distinct()
        fresh = materialize(step.join(known.select("child", "parent"), ["child", "parent"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        frontier = fresh
    return known


def reachable(edges: DataFrame, start: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of what can be reached from the ids in ``start`` (column id, depth 0 themselves)."""
    links = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s IS NOT NULL AND t IS NOT NULL")
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        fresh = frontier.join(links, F.col("id") == F.col("s")).select(F.col("t").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        fresh = materialize(fresh.withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen
