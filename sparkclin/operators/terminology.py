"""Terminology: expansion, lookup, validation, subsumption, translation and closure over code tables.

Concepts are rows (system, code, display, active, properties map); hierarchies are edges (system, child, parent), so a
code may have several parents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.operators.hierarchy import closure, reachable

CONCEPT = "system string, code string, display string, active boolean, properties map<string,string>"
UNMATCHED = ("unmatched", "disjoint")


def flatten_concepts(systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts and edges of code systems given as (url, concept: nested array of struct<code, display, concept>), to the end of the schema."""
    level = systems.select(F.col("url").alias("system"), F.explode("concept").alias("c"), F.lit(None).cast("string").alias("parent"))
    concepts, edges = [], []
    while True:
        concepts.append(level.select("system", F.col("c.code").alias("code"), F.col("c.display").alias("display"), F.lit(True).alias("active"), F.create_map().cast("map<string,string>").alias("properties")))
        edges.append(level.filter("parent IS NOT NULL").select("system", F.col("c.code").alias("child"), "parent"))
        if "concept" not in level.schema["c"].dataType.fieldNames():
            break
        level = level.select("system", F.explode("c.concept").alias("k"), F.col("c.code").alias("parent")).withColumnRenamed("k", "c")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(concepts).dropDuplicates(["system", "code"]), union(edges).distinct()


@dataclass
class Include:
    """A part of a value set: codes, filters (property, op, value), or other value sets; a system alone means all of it."""

    system: str | None = None
    codes: list[str] = field(default_factory=list)
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    value_sets: list[str] = field(default_factory=list)


@dataclass
class ValueSet:
    url: str
    include: list[Include]
    exclude: list[Include] = field(default_factory=list)


class Terminology:
    def __init__(self, concepts: DataFrame, edges: DataFrame, value_sets: dict[str, ValueSet] | None = None, maps: DataFrame | None = None):
        self.concepts, self.edges, self.value_sets, self.maps = concepts, edges, value_sets or {}, maps

    @property
    def spark(self) -> SparkSession:
        return self.concepts.sparkSession

    def _one(self, code: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(code).alias("id"))

    def descendants(self, system: str, code: str) -> DataFrame:
        """(code, depth), the code itself at depth 0."""
        edges = self.edges.filter(F.col("system") == system)
        return reachable(edges, self._one(code), "parent", "child").withColumnRenamed("id", "code")

    def ancestors(self, system: str, code: str) -> DataFrame:
        edges = self.edges.filter(F.col("system") == system)
        return reachable(edges, self._one(code), "child", "parent").withColumnRenamed("id", "code")

    def filtered(self, system: str, prop: str, op: str, value: str) -> DataFrame:
        rows = self.concepts.filter(F.col("system") == system)
        if op in ("is-a", "descendent-of"):
            below = self.descendants(system, value)
            return rows.join(below.filter("depth > 0") if op == "descendent-of" else below, "code", "left_semi")
        if op == "is-not-a":
            return rows.join(self.descendants(system, value), "code", "left_anti")
        of = {"code": F.col("code"), "display": F.col("display")}.get(prop, F.try_element_at("properties", F.lit(prop)))
        tests = {"=": of == value, "in": of.isin(*[v.strip() for v in value.split(",")]), "not-in": ~of.isin(*[v.strip() for v in value.split(",")]), "regex": of.rlike(f"^(?:{value})$"), "exists": of.isNotNull() if value == "true" else of.isNull()}
        if op not in tests:
            raise ValueError(f"unknown filter {op}")
        return rows.filter(tests[op])

    def compose(self, part: Include, seen: tuple[str, ...] = ()) -> DataFrame:
        """The concepts of one include; several filters must all hold."""
        out = None
        if part.system is not None:
            rows = self.concepts.filter(F.col("system") == part.system)
            if part.codes:
                rows = rows.filter(F.col("code").isin(*part.codes))
            for f in part.filters:
                rows = rows.join(self.filtered(part.system, *f).select("code"), "code", "left_semi")
            out = rows
        for url in part.value_sets:
            if url in seen:
                raise ValueError(f"value set {url} includes itself")
            inner = self.expansion(url, seen)
            out = inner if out is None else out.join(inner.select("system", "code"), ["system", "code"], "left_semi")
        if out is None:
            raise ValueError("an include needs a system or a value set")
        return out.select("system", "code", "display", "active", "properties")

    def expansion(self, url: str, seen: tuple[str, ...] = ()) -> DataFrame:
        """All concepts of a value set: the union of its includes, each code once, without its excludes."""
        vs = self.value_sets[url]
        rows = reduce(DataFrame.unionByName, [self.compose(p, (*seen, url)) for p in vs.include]).dropDuplicates(["system", "code"])
        for part in vs.exclude:
            rows = rows.join(self.compose(part, (*seen, url)).select("system", "code"), ["system", "code"], "left_anti")
        return rows

    def expand(self, url: str, text: str | None = None, active_only: bool = False, offset: int = 0, count: int = 1000) -> DataFrame:
        """A page of the expansion in order of system and code; ``text`` must occur in code or display, in any case."""
        rows = self.expansion(url)
        if text:
            rows = rows.filter(F.contains(F.lower("code"), F.lit(text.lower())) | F.coalesce(F.contains(F.lower("display"), F.lit(text.lower())), F.lit(False)))
        if active_only:
            rows = rows.filter("active")
        return rows.orderBy("system", "code").offset(offset).limit(count).select("system", "code", "display")

    def lookup(self, codes: DataFrame) -> DataFrame:
        """Display and properties of (system, code) rows; ``found`` says whether the code exists."""
        return codes.join(self.concepts, ["system", "code"], "left").select(*codes.columns, "display", "active", "properties", F.col("display").isNotNull().alias("found"))

    def validate_code(self, codes: DataFrame, url: str | None = None) -> DataFrame:
        """``result`` and ``message`` for (system, code[, display]) rows, against a value set or the code system."""
        known = (self.expansion(url) if url else self.concepts).select("system", "code", F.col("display").alias("expected"), F.lit(True).alias("known"))
        out = codes.join(known, ["system", "code"], "left")
        given = F.col("display") if "display" in codes.columns else F.lit(None).cast("string")
        wrong = given.isNotNull() & (F.lower(given) != F.lower("expected"))
        message = F.when(F.col("known").isNull(), "unknown code").when(wrong, "wrong display")
        return out.select(*codes.columns, (F.col("known").isNotNull() & ~F.coalesce(wrong, F.lit(False))).alias("result"), message.alias("message"))

    def subsumes(self, pairs: DataFrame) -> DataFrame:
        """``outcome`` for rows (system, a, b)."""
        up = self.closure_pairs()
        ab = up.select("system", F.col("child").alias("b"), F.col("parent").alias("a"), F.lit(True).alias("over"))
        ba = up.select("system", F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(True).alias("under"))
        out = pairs.join(ab, ["system", "a", "b"], "left").join(ba, ["system", "a", "b"], "left")
        outcome = F.when(F.col("a") == F.col("b"), "equivalent").when(F.col("over"), "subsumes").when(F.col("under"), "subsumed-by").otherwise("not-subsumed")
        return out.select(*pairs.columns, outcome.alias("outcome"))

    def closure_pairs(self) -> DataFrame:
        """(system, child, parent) of the whole hierarchy."""
        edges = self.edges.select(F.struct("system", F.col("child").alias("code")).alias("child"), F.struct("system", F.col("parent").alias("code")).alias("parent"))
        pairs = closure(edges)
        return pairs.select(F.col("child.system").alias("system"), F.col("child.code").alias("child"), F.col("parent.code").alias("parent"))

    def closure_delta(self, members: DataFrame, since: int = 0) -> DataFrame:
        """Subsumption pairs among a client's codes (system, code, version added), those that a version after ``since`` brought."""
        pairs = self.closure_pairs()
        low = members.select("system", F.col("code").alias("child"), F.col("version").alias("v1"))
        high = members.select("system", F.col("code").alias("parent"), F.col("version").alias("v2"))
        out = pairs.join(low, ["system", "child"]).join(high, ["system", "parent"]).withColumn("version", F.greatest("v1", "v2"))
        return out.filter(F.col("version") > since).select("system", "child", "parent", "version")

    def translate(self, codes: DataFrame, reverse: bool = False) -> DataFrame:
        """Matches of (system, code) rows in the maps (source, code, target, target_code, equivalence), with ``result``."""
        m = self.maps
        if reverse:
            m = m.select(F.col("target").alias("source"), F.col("target_code").alias("code"), F.col("source").alias("target"), F.col("code").alias("target_code"), "equivalence")
        out = codes.join(m.withColumnRenamed("source", "system"), ["system", "code"], "left")
        ok = F.col("target_code").isNotNull() & ~F.coalesce(F.col("equivalence").isin(*UNMATCHED), F.lit(False))
        return out.select(*codes.columns, "target", "target_code", "equivalence", ok.alias("result"))
