"""JSON, XML and package sources and sinks of resources."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclin.session import ship_package

NAMESPACE, XHTML = "http://hl7.org/fhir", "http://www.w3.org/1999/xhtml"

#: Elements that repeat even if a document has one of them.
REPEATING = {
    "name", "given", "prefix", "suffix", "identifier", "telecom", "address", "line", "coding", "extension", "modifierExtension", "contained",
    "contact", "entry", "link", "parameter", "part", "category", "performer", "component", "item", "answer", "concept", "include", "exclude",
    "filter", "element", "target", "group", "member", "participant", "communication", "generalPractitioner", "photo", "note", "interpretation",
    "referenceRange", "result", "media", "evidence", "bodySite", "property", "designation", "profile", "tag", "security", "relationship", "constraint", "type_list",
}
NUMERIC = {"value_decimal", "min", "rank", "count", "total", "minutesDuration", "sequence", "multipleBirthInteger", "valueInteger", "valueDecimal", "valuePositiveInt", "valueUnsignedInt"}
_BOOLEAN = {"true": True, "false": False}


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Resources of newline-delimited JSON: the text, its type and id, and the typed resource if a schema is given."""
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "json")
    rows = rows.select("json", F.get_json_object("json", "$.resourceType").alias("resource_type"), F.get_json_object("json", "$.id").alias("id"))
    return rows.withColumn("resource", F.from_json("json", schema)) if schema is not None else rows


def write_json_lines(df: DataFrame, path: str, resource: str = "resource") -> None:
    """One JSON text a line, in a folder for each type."""
    df.select("resource_type", F.to_json(resource).alias("value")).write.partitionBy("resource_type").text(path)


def as_variant(df: DataFrame, json_column: str = "json") -> DataFrame:
    """``df`` with a VARIANT of the text, for paths that no schema has."""
    return df.withColumn("variant", F.parse_json(json_column))


def _scalar(name: str, text: str, parent: str):
    if text in _BOOLEAN:
        return _BOOLEAN[text]
    if name in NUMERIC or name == "value" and parent in ("valueQuantity", "low", "high", "numerator", "denominator", "valueAge", "doseQuantity"):
        return float(text) if "." in text or "e" in text.lower() else int(text)
    return text


def _from_xml(node: ET.Element, parent: str = ""):
    name = node.tag.rpartition("}")[2]
    if node.tag.startswith("{" + XHTML):
        return ET.tostring(node, encoding="unicode").replace("html:", "").replace("ns0:", "").replace("xmlns:html", "xmlns").replace("xmlns:ns0", "xmlns"), None
    out: dict = {}
    for key in ("id", "url"):
        if key in node.attrib:
            out[key] = node.attrib[key]
    for child in node:
        key = child.tag.rpartition("}")[2]
        if key in ("contained", "resource") and len(child) == 1 and child[0].tag.rpartition("}")[2][:1].isupper():
            value, side = xml_to_dict(child[0]), None
        else:
            value, side = _from_xml(child, name)
        for k, v in ((key, value), ("_" + key, side)):
            if v is None:
                continue
            if key in REPEATING or k in out:
                out[k] = out[k] if isinstance(out.get(k), list) else ([] if k not in out else [out[k]])
                out[k].append(v)
            else:
                out[k] = v
    if "value" in node.attrib:
        return _scalar(name, node.attrib["value"], parent), out or None
    return out, None


def xml_to_dict(node: ET.Element) -> dict:
    body, _ = _from_xml(node)
    return {"resourceType": node.tag.rpartition("}")[2], **body}


def xml_to_json(text: str) -> str:
    """A resource in XML as JSON: attributes are values, repeating elements arrays, primitives with children get a sibling ``_name``."""
    return json.dumps(xml_to_dict(ET.fromstring(text)), ensure_ascii=False)


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def _to_xml(name: str, value, side=None) -> str:
    if isinstance(value, list):
        sides = side if isinstance(side, list) else [None] * len(value)
        return "".join(_to_xml(name, v, s) for v, s in zip(value, sides))
    if name == "div" and isinstance(value, str):
        return value
    if isinstance(value, dict):
        if "resourceType" in value:
            return f"<{name}>{dict_to_xml(value, inner=True)}</{name}>"
        attributes = "".join(f' {k}="{_escape(str(value[k]))}"' for k in ("id", "url") if k in value and (k == "id" or name in ("extension", "modifierExtension")))
        body = "".join(_to_xml(k, v, value.get("_" + k)) for k, v in value.items() if not k.startswith("_") and not (k == "id" or k == "url" and name in ("extension", "modifierExtension")))
        return f"<{name}{attributes}>{body}</{name}>"
    inner = "".join(_to_xml(k, v) for k, v in (side or {}).items())
    if value is None:
        return f"<{name}>{inner}</{name}>" if inner else ""
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return f'<{name} value="{_escape(text)}">{inner}</{name}>' if inner else f'<{name} value="{_escape(text)}"/>'


def dict_to_xml(resource: dict, inner: bool = False) -> str:
    body = "".join(_to_xml(k, v, resource.get("_" + k)) for k, v in resource.items() if k != "resourceType" and not k.startswith("_"))
    name, space = resource["resourceType"], "" if inner else f' xmlns="{NAMESPACE}"'
    return f"<{name}{space}>{body}</{name}>"


def json_to_xml(text: str) -> str:
    return dict_to_xml(json.loads(text))


def convert(df: DataFrame, source: str, target: str, to: str) -> DataFrame:
    """``df`` with column ``target``: ``source`` converted to "xml" or "json", in Arrow batches; null stays null."""
    ship_package(df.sparkSession)
    one = json_to_xml if to == "xml" else xml_to_json

    @F.pandas_udf(T.StringType())
    def run(values):
        return values.map(lambda v: one(v) if v is not None else None)

    return df.withColumn(target, run(source))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Resources in package archives (.tgz): package, version, file, resource_type, id, url, json; one archive at a time."""
    ship_package(spark)
    import pyarrow as pa

    fields = ["package", "version", "file", "resource_type", "id", "url", "json"]
    schema = pa.schema([(f, pa.string()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                manifest, rows = {}, []
                with tarfile.open(fileobj=io.BytesIO(gzip.decompress(content.as_py()))) as tar:
                    for m in tar:
                        if not m.isfile() or not m.name.endswith(".json"):
                            continue
                        doc = json.load(tar.extractfile(m))
                        if m.name.endswith("package/package.json"):
                            manifest = doc
                        elif isinstance(doc, dict) and "resourceType" in doc:
                            rows.append({"file": m.name, "resource_type": doc["resourceType"], "id": doc.get("id"), "url": doc.get("url"), "json": json.dumps(doc, ensure_ascii=False)})
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist([{"package": manifest.get("name"), "version": manifest.get("version"), **r} for r in rows[at : at + 500]], schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{f} string" for f in fields))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Resources of a folder of JSON files, one resource a file."""
    rows = spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
    return rows.select("json", *[F.get_json_object("json", f"$.{k}").alias(c) for k, c in (("resourceType", "resource_type"), ("id", "id"), ("url", "url"), ("version", "version"))])


def version_key(column):
    """An array by which versions order: numbers by value, a pre-release before its release."""
    main = F.regexp_extract(column, r"^v?([0-9.]+)", 1)
    parts = F.transform(F.split(main, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    release = F.when(column.contains("-"), F.lit(0)).otherwise(F.lit(1))
    return F.concat(F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4), F.array(release))


def latest_versions(df: DataFrame, by: str = "url", version: str = "version") -> DataFrame:
    """The row of the highest version for each key."""
    order = Window.partitionBy(by).orderBy(version_key(F.col(version)).desc(), F.col(version).desc())
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def resolve_canonical(df: DataFrame, references: DataFrame, column: str = "canonical") -> DataFrame:
    """``references`` (url or url|version) with the resource they name; without a version the latest."""
    url, version = F.substring_index(column, "|", 1), F.when(F.contains(F.col(column), F.lit("|")), F.substring_index(column, "|", -1))
    wanted = references.withColumn("__url", url).withColumn("__version", version)
    latest = latest_versions(df).select("url", F.col("version").alias("latest"))
    out = wanted.join(latest, F.col("__url") == F.col("url"), "left").drop("url").withColumn("__version", F.coalesce("__version", "latest")).drop("latest")
    found = df.select(F.col("url").alias("__u"), F.col("version").alias("__v"), F.col("json").alias("resolved"))
    return out.join(found, (F.col("__url") == F.col("__u")) & (F.col("__version") == F.col("__v")), "left").drop("__u", "__v", "__url").withColumnRenamed("__version", "resolved_version")
