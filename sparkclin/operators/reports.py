"""Reports over the version table and its indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclin.operators.history import current


def type_stats(versions: DataFrame) -> DataFrame:
    """For each type: versions, current resources, deletions, latest change."""
    newest = current(versions).groupBy("resource_type").agg(F.count(F.lit(1)).alias("current"))
    all_ = versions.groupBy("resource_type").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.coalesce("deleted", F.lit(False))).alias("deletions"), F.countDistinct("id").alias("ids"), F.max("last_updated").alias("latest"))
    return all_.join(newest, "resource_type", "left").select("resource_type", "versions", "ids", F.coalesce("current", F.lit(0)).alias("current"), "deletions", "latest")


def index_coverage(resources: DataFrame, index: DataFrame, parameters: list[str]) -> DataFrame:
    """For each parameter: how many resources have a row in the index, and how many do not."""
    total = resources.agg(F.countDistinct("id").alias("resources"))
    names = resources.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in parameters])).alias("parameter_name"))
    have = index.groupBy("parameter_name").agg(F.countDistinct("id").alias("indexed"), F.count(F.lit(1)).alias("entries"))
    return names.join(have, "parameter_name", "left").join(F.broadcast(total)).select("parameter_name", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("entries", F.lit(0)).alias("entries"), (F.col("resources") - F.coalesce("indexed", F.lit(0))).alias("missing"))


def duplicate_hashes(index: DataFrame, values: list[str]) -> DataFrame:
    """Hashes that stand for more than one index row."""
    hashed = index.select(F.md5(F.concat_ws("|", *[F.col(v).cast("string") for v in values]).cast("binary")).alias("entry_hash"))
    return hashed.groupBy("entry_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """References to resources that do not exist."""
    known = targets.select(F.col("resource_type").alias("target_type"), F.col("id").alias("target_id"))
    return references.filter("target_id IS NOT NULL").join(known, ["target_type", "target_id"], "left_anti")


def referencing(references: DataFrame, kind: str, ident: str) -> DataFrame:
    """Resources that refer to one."""
    return references.filter((F.col("target_type") == kind) & (F.col("target_id") == ident)).select("resource_type", "id", "parameter_name")


def top_groups(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), by).limit(n)


def job_stats(jobs: DataFrame) -> DataFrame:
    """Counts by state and the mean duration of finished jobs (status, started, finished)."""
    took = F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return jobs.groupBy("kind").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg(F.when(F.col("status") == "done", took / 1e6)).alias("mean_seconds"),
    )
