"""Resources made from the star-schema tables, as typed structs: one DataFrame for each resource type.

Every DataFrame has resource_type, id, version_id, last_updated and resource. Columns are pruned down to the
Parquet scan, as resources are built by projections only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2020-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _resource(df: DataFrame, kind: str, key: Column, *fields: Column, version: Column | None = None, updated: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(kind).alias("resource_type"),
        key.alias("id"),
        (F.lit(1) if version is None else version).cast("long").alias("version_id"),
        (F.lit(EPOCH).cast("timestamp") if updated is None else updated).alias("last_updated"),
        F.struct(F.lit(kind).alias("resourceType"), key.alias("id"), *fields).alias("resource"),
    )


def _reference(prefix: str, c: str) -> Column:
    return F.struct(F.concat(F.lit(prefix), _s(c)).alias("reference"))


def _coding(system: str, code: Column, display: Column | None = None) -> Column:
    return F.struct(F.lit(system).alias("system"), code.alias("code"), (F.lit(None).cast("string") if display is None else display).alias("display"))


def _concept(*codings: Column) -> Column:
    return F.struct(F.array(*codings).alias("coding"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource(
        read(spark, sf_dir, "customer"), "Patient", _s("c_custkey"),
        F.array(F.struct(F.split("c_name", "#")[0].alias("family"), F.array(F.split("c_name", "#")[1]).alias("given"), F.col("c_name").alias("text"))).alias("name"),
        F.array(F.struct(F.struct(F.array(_coding("http://terminology.hl7.org/CodeSystem/v2-0203", F.lit("MR"))).alias("coding")).alias("type"), F.lit("urn:customer").alias("system"), _s("c_custkey").alias("value"))).alias("identifier"),
        (F.col("c_acctbal") >= 0).alias("active"),
        F.array(F.struct(_s("c_nationkey").alias("country"))).alias("address"),
        F.col("c_acctbal").alias("balance"),
        _concept(_coding("urn:segment", F.col("c_mktsegment"), F.initcap("c_mktsegment"))).alias("segment"),
        _reference("Location/nation-", "c_nationkey").alias("location"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("region-"), _s("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("up"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), _s("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("Location/region-"), _s("n_regionkey")).alias("up"))
    both = region.unionByName(nation)
    return _resource(both, "Location", F.col("id"), F.col("name"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("reference"))).alias("partOf"))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource(read(spark, sf_dir, "supplier"), "Organization", _s("s_suppkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), _reference("Location/nation-", "s_nationkey").alias("location"))


def medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource(
        read(spark, sf_dir, "part"), "Medication", _s("p_partkey"),
        _concept(_coding("urn:brand", F.col("p_brand"), F.col("p_name")), _coding("urn:type", F.col("p_type"))).alias("code"),
        F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _resource(
        read(spark, sf_dir, "orders"), "Encounter", _s("o_orderkey"),
        F.col("o_orderstatus").alias("status"), _reference("Patient/", "o_custkey").alias("subject"),
        F.struct(day.alias("start"), day.alias("end")).alias("period"),
        _concept(_coding("urn:priority", F.col("o_orderpriority"))).alias("priority"), F.col("o_totalprice").alias("total"),
        updated=F.col("o_orderdate"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    part = lambda code, c: F.struct(_concept(_coding("urn:component", F.lit(code))).alias("code"), F.struct(F.col(c).alias("value"), F.lit("1").alias("code")).alias("valueQuantity"))
    return _resource(
        item, "Observation", F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_suppkey"), F.date_format("l_shipdate", "yyyyMMdd")),
        F.col("l_linestatus").alias("status"), _concept(_coding("urn:returnflag", F.col("l_returnflag"))).alias("code"),
        _reference("Encounter/", "l_orderkey").alias("encounter"), _reference("Medication/", "l_partkey").alias("focus"),
        F.array(_reference("Organization/", "l_suppkey")).alias("performer"),
        F.struct(F.col("l_quantity").alias("value"), F.lit("http://unitsofmeasure.org").alias("system"), F.lit("mg").alias("code"), F.lit("mg").alias("unit")).alias("valueQuantity"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("effectiveDateTime"),
        F.array(part("price", "l_extendedprice"), part("discount", "l_discount"), part("tax", "l_tax")).alias("component"),
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions: the events of a user, oldest first; a signup event after others counts as a deletion."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("version", F.row_number().over(order))
    return _resource(
        e, "AuditEvent", _s("user_id"), F.col("event_type").alias("action"), F.col("value").alias("amount"), F.col("props").alias("detail"), _s("event_id").alias("event"),
        version=F.col("version"), updated=F.col("ts"),
    ).withColumn("deleted", (F.col("resource.action") == "error") & (F.col("version_id") > 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource(read(spark, sf_dir, "documents"), "DocumentReference", _s("doc_id"), F.col("text").alias("description"), F.col("lang").alias("language"), F.col("source").alias("source"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource(read(spark, sf_dir, "pages"), "Composition", _s("page_id"), F.col("url"), F.struct(F.lit("generated").alias("status"), F.col("html").alias("div")).alias("text"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections of documents: of good quality, and toxic ones."""
    labels = read(spark, sf_dir, "labels")
    member = F.struct(F.struct(F.concat(F.lit("DocumentReference/"), _s("doc_id")).alias("reference")).alias("entity"), (F.col("toxic") == 1).alias("inactive"))
    one = labels.groupBy("quality").agg(F.collect_list(member).alias("member"))
    return _resource(one, "Group", F.concat(F.lit("quality-"), _s("quality")), F.col("member"))


def communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("sequence"), F.col("role").alias("role"), F.col("text").alias("content")))).alias("payload"))
    return _resource(one, "Communication", _s("conv_id"), F.col("payload"))


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource(read(spark, sf_dir, "embeddings"), "Specimen", _s("vec_id"), F.col("embedding").alias("reading"), F.col("label").cast("long").alias("label"))


MAKERS = {
    "Patient": patients, "Location": locations, "Organization": organizations, "Medication": medications, "Encounter": encounters,
    "Observation": observations, "AuditEvent": audit_events, "DocumentReference": documents, "Composition": pages, "Group": groups,
    "Communication": communications, "Specimen": specimens,
}
