"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.session import ship_package

#: White space of the word rules: blank and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's settings of Arrow batches: its default, and ours in its place.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors' path.

    Where the session has Spark's defaults of 10,000 rows and 64 MB a batch, they are lowered for the session to 1,000 rows
    and 16 MB, as a batch of texts is held in a worker several times over. Other settings of the caller stay.
    """
    spark = df.sparkSession
    ship_package(spark)
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    return df.mapInArrow(function, schema)


def whole_text(name: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Only where it is unset (tests, one machine) a temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_alive: list[DataFrame] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    _alive.append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        _alive[:] = [t for t in _alive if t is not df]


def written_since(count: int = 0) -> list[DataFrame]:
    """The tables of ``written`` not deleted yet, without the first ``count``; for callers that have read their results."""
    return _alive[count:]


def fresh_key(name: str) -> Column:
    """A string key equal to ``name`` that Catalyst takes for a new one.

    A join on it deals out both sides by exchanges of its own, which adaptive execution can split where
    a key is hot; the exchange of an aggregate just below could not be split.
    """
    return F.concat(F.col(name), F.lit(""))


def fresh_key_long(name: str) -> Column:
    """``fresh_key`` for a key of type long."""
    return F.col(name).bitwiseXOR(F.lit(0).cast("bigint"))


def settled(column: Column) -> Column:
    """``column``, marked so that a filter above is not pushed below its projection.

    Pushing it down would put the definitions of all columns it uses in its place, and then lambdas would evaluate
    whole arrays anew for every element. The condition always holds; it only counts as not deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)
