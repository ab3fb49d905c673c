"""Incremental maintenance of the version table and its indexes from a stream of resources.

Each micro-batch writes folders of its own, named by the query's checkpoint and the batch's number, and then an empty file
that commits it; readers look at committed batches alone. A batch that failed midway and is run again overwrites what it
had written, one that is run again after its commit is passed over, and a version that another batch has brought, known
by (resource_type, id, version_id), adds nothing. The windowed activity query is an extension of this engine.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkclin.operators import indexing
from sparkclin.plans.catalog import Catalog

KEYS = ["resource_type", "id", "version_id"]
#: Resources that a task of a micro-batch sorts and shreds at a time, about; those of a file, where the caller writes them.
ROWS = 100_000


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files of resources (resource_type, id, version_id, last_updated, resource)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed(spark: SparkSession, out: str) -> list[str]:
    """The names of the batches whose commit file exists."""
    fs, folder = _path(spark, f"{out}/commits")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def _commit(spark: SparkSession, out: str, batch: str) -> None:
    fs, file = _path(spark, f"{out}/commits/{batch}")
    fs.create(file, True).close()


def _read(spark: SparkSession, base: str, batches: list[str], schema: T.StructType | None = None) -> DataFrame | None:
    paths = [p for b in batches if (at := _path(spark, p := f"{base}/batch={b}"))[0].exists(at[1])]
    reader = spark.read.option("basePath", base)
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths) if paths else None


def read_versions(spark: SparkSession, out: str) -> DataFrame | None:
    """The version table as far as it is committed; null before the first commit."""
    return _read(spark, f"{out}/versions", committed(spark, out))


def read_index(spark: SparkSession, out: str, kind: str) -> DataFrame | None:
    """The committed index rows of a kind, or of composite-code; null where there are none."""
    return _read(spark, f"{out}/index/{kind}", committed(spark, out))


def _deal(df: DataFrame) -> DataFrame:
    """``df`` dealt out by its keys to tasks of about ROWS rows.

    Dropping duplicates needs no exchange after that. With its own, each task that reads would sort all it has read first.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ROWS)), *KEYS)


def write_batch(df: DataFrame, out: str, batch: str, catalog: Catalog) -> None:
    """Writes the versions of ``df`` that no committed batch holds, and their index rows, and commits them."""
    spark = df.sparkSession
    done = committed(spark, out)
    if batch in done:
        return
    rows = _deal(df).dropDuplicates(KEYS).persist()
    kinds = [r.resource_type for r in rows.select("resource_type").distinct().collect()]
    # versions lie in a folder for each type, so only the keys of the batch's types are read
    schema = T.StructType([*(f for f in df.schema.fields if f.name in KEYS), T.StructField("batch", T.StringType())])
    known = _read(spark, f"{out}/versions", done, schema)
    fresh = rows if known is None else rows.join(known.filter(F.col("resource_type").isin(kinds)).select(*KEYS), KEYS, "left_anti")
    fresh = fresh.persist()
    for kind in kinds:
        own = fresh.filter(F.col("resource_type") == kind)
        for name, index in indexing.index_all(own, catalog.of_type(kind)).items():
            folder = f"{out}/index/{name.replace(':', '-')}/batch={batch}/resource_type={kind}"
            index.drop("resource_type").write.mode("overwrite").partitionBy("parameter_name").parquet(folder)
    fresh.write.mode("overwrite").partitionBy("resource_type").parquet(f"{out}/versions/batch={batch}")
    _commit(spark, out, batch)
    fresh.unpersist()
    rows.unpersist()


def maintain(stream: DataFrame, out: str, checkpoint: str, catalog: Catalog | None = None) -> StreamingQuery:
    """Adds new versions of each micro-batch to ``out``/versions and their index rows to ``out``/index/kind."""
    catalog = catalog or Catalog.default()
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, epoch: int) -> None:
        write_batch(df, out, f"{query}-{epoch}", catalog)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum by type in windows, with late data up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: events closer together than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
