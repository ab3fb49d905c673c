"""Shredding: the values of search parameters, extracted from typed resources into index rows.

One index DataFrame for each kind of parameter, with resource_type, id, version_id and parameter_name besides its
value columns. All parameters of a kind and type are extracted in one projection and one explode, not one scan each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclin.fhirpath.compiler import Typed, compile_expression
from sparkclin.functions import text as tx
from sparkclin.plans.catalog import SearchParam

KEYS = ("resource_type", "id", "version_id")


def _fields(t: T.DataType) -> set[str]:
    return set(t.fieldNames()) if isinstance(t, T.StructType) else set()


def _each(v: Typed, build) -> Column:
    """An array of what ``build`` makes of every item (an array each), without nulls."""
    return F.filter(F.flatten(F.transform(v.array().column, build)), lambda x: x.isNotNull())


def _string(x: Column, t: T.DataType) -> Column:
    """Texts of a value: a string itself, names and addresses by their parts."""
    if isinstance(t, T.StringType):
        return F.array(x)
    if isinstance(t, T.StructType):
        parts = []
        for name in ("family", "given", "prefix", "suffix", "text", "value", "line", "city", "district", "state", "postalCode", "country"):
            if name in t.fieldNames():
                f = t[name].dataType
                parts.append(F.coalesce(x.getField(name), F.array().cast("array<string>")) if isinstance(f, T.ArrayType) else F.array(x.getField(name).cast("string")))
        if parts:
            return F.concat(*parts)
    return F.array(x.cast("string"))


def family_parts(x: Column) -> Column:
    """Parts of a family name, split at white space and - _ , ; and full stops."""
    return F.filter(F.split(x, r"[\s\-_,;.]+"), lambda p: p != "")


TOKEN = "struct<system:string,code:string,code_ci:string,display:string>"


def _token_struct(system, code: Column, display=None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((null if system is None else system).alias("system"), code.alias("code"), F.lower(code).alias("code_ci"), (null if display is None else display).alias("display"))


def _token(x: Column, t: T.DataType) -> Column:
    names = _fields(t)
    get = lambda s, n, of: s.getField(n) if n in of else F.lit(None).cast("string")
    if "coding" in names:
        inner = _fields(t["coding"].dataType.elementType)
        return F.transform(x.getField("coding"), lambda c: _token_struct(get(c, "system", inner), get(c, "code", inner), get(c, "display", inner)))
    if "code" in names:
        return F.array(_token_struct(get(x, "system", names), x.getField("code"), get(x, "display", names)))
    if "value" in names:  # Identifier, and ContactPoint whose system is no code system
        contact = "rank" in names or "use" in names and "type" not in names and "assigner" not in names
        return F.array(_token_struct(None if contact else get(x, "system", names), x.getField("value").cast("string")))
    return F.array(_token_struct(None, x.cast("string")))


def _bound(text: Column, high: bool) -> Column:
    """Start or exclusive end of what a date text of any precision stands for, in UTC."""
    n = F.length(text)
    year = F.try_to_timestamp(F.concat(F.substring(text, 1, 4), F.lit("-01-01")))
    month = F.try_to_timestamp(F.concat(F.substring(text, 1, 7), F.lit("-01")))
    day = F.try_to_timestamp(F.substring(text, 1, 10))
    exact = F.try_to_timestamp(text)
    if not high:
        return F.when(n == 4, year).when(n == 7, month).when(n == 10, day).otherwise(exact)
    step = F.when(text.rlike(r"T\d\d:\d\d(Z|[+-]|$)"), F.expr("INTERVAL 1 MINUTE")).when(text.rlike(r"\.\d"), F.expr("INTERVAL 0.001 SECOND")).otherwise(F.expr("INTERVAL 1 SECOND"))
    return F.when(n == 4, F.add_months(year, 12).cast("timestamp")).when(n == 7, F.add_months(month, 1).cast("timestamp")).when(n == 10, F.date_add(day.cast("date"), 1).cast("timestamp")).otherwise(exact + step)


def _date(x: Column, t: T.DataType) -> Column:
    names = _fields(t)
    low, high = F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59").cast("timestamp")
    if {"start", "end"} & names:
        start = _bound(x.getField("start"), False) if "start" in names else low
        end = _bound(x.getField("end"), True) if "end" in names else high
        return F.array(F.struct(F.coalesce(start, low).alias("start_date"), F.coalesce(end, high).alias("end_date")))
    if "event" in names:
        events = x.getField("event")
        return F.array(F.struct(F.array_min(F.transform(events, lambda e: _bound(e, False))).alias("start_date"), F.array_max(F.transform(events, lambda e: _bound(e, True))).alias("end_date")))
    return F.filter(F.array(F.struct(_bound(x, False).alias("start_date"), _bound(x, True).alias("end_date"))), lambda d: d["start_date"].isNotNull())


def _number(x: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        x = x.getField("value")
    return F.array(x.try_cast("double") if isinstance(t, T.StringType) else x.cast("double"))


def _quantity(x: Column, t: T.DataType) -> Column:
    names, null = _fields(t), F.lit(None).cast("string")
    get = lambda n: x.getField(n) if n in names else null
    return F.array(F.struct(x.getField("value").cast("double").alias("value"), get("system").alias("system"), get("code").alias("code"), get("unit").alias("unit")))


def parse_reference(ref: Column) -> Column:
    """kind, target_type, target_id, version and url of a reference text; of a fragment the target_id is its name."""
    fragment = ref.startswith("#")
    absolute = ref.rlike(r"^[a-z][a-z0-9+.-]*:")
    pattern = r"(?:^|/)([A-Z][A-Za-z]+)/([A-Za-z0-9.\-]+)(?:/_history/([A-Za-z0-9.\-]+))?$"
    part = lambda k: F.nullif(F.regexp_extract(ref, pattern, k), F.lit(""))
    typed = part(1).isNotNull()
    kind = F.when(fragment, "fragment").when(absolute & ~typed, "canonical").when(absolute, "absolute").otherwise("relative")
    return F.struct(
        kind.alias("reference_kind"), F.when(~fragment, part(1)).alias("target_type"), F.when(fragment, F.substring(ref, 2, F.length(ref))).when(typed, part(2)).when(~absolute, ref).alias("target_id"), part(3).alias("target_version_id"),
        F.when(absolute, F.substring_index(ref, "|", 1)).alias("target_url"), F.when(F.contains(ref, F.lit("|")), F.substring_index(ref, "|", -1)).alias("canonical_version"),
    )


REFERENCE = "struct<reference_kind:string,target_type:string,target_id:string,target_version_id:string,target_url:string,canonical_version:string,display:string>"


def _reference(x: Column, t: T.DataType) -> Column:
    ref = x.getField("reference") if "reference" in _fields(t) else x.cast("string")
    display = x.getField("display") if "display" in _fields(t) else F.lit(None).cast("string")
    return F.when(ref.isNotNull(), F.array(parse_reference(ref).withField("display", display))).otherwise(F.array().cast(f"array<{REFERENCE}>"))


EXTRACTORS = {"string": _string, "token": _token, "date": _date, "number": _number, "quantity": _quantity, "reference": _reference, "uri": _string}


def extract(df: DataFrame, param: SearchParam, resource: str = "resource") -> Column:
    """The array of index values of one parameter."""
    v = compile_expression(param.expression, F.col(resource), df.schema[resource].dataType)
    if param.kind == "composite":
        return _composite(v, param)
    build = EXTRACTORS[param.kind]
    return _each(v, lambda x: build(x, v.type))


def component_values(x: Column, t: T.DataType, expression: str, kind: str) -> Column:
    """The index values of one component within a group of a composite."""
    c = compile_expression(expression, x, t)
    return _each(c, lambda y: EXTRACTORS[kind](y, c.type))


def _composite(v: Typed, param: SearchParam) -> Column:
    """Tuples of the components' values within each group."""

    def product(out: Column, more: Column, k: int) -> Column:
        one = lambda a: F.transform(more, lambda b: F.struct(*[a.getField(f"c{j}").alias(f"c{j}") for j in range(k)], b.alias(f"c{k}")))
        return F.flatten(F.transform(out, one))

    def tuples(x: Column) -> Column:
        parts = [component_values(x, v.type, expression, kind) for _, expression, kind in param.components]
        out = F.transform(parts[0], lambda a: F.struct(a.alias("c0")))
        for k, more in enumerate(parts[1:], 1):
            out = product(out, more, k)
        return out

    return F.flatten(F.transform(v.array().column, tuples))


def _values(kind: str) -> list[Column]:
    if kind == "string":
        return [F.col("v").alias("value"), tx.normalize(F.col("v")).alias("value_normalized")]
    if kind == "uri":
        return [F.col("v").alias("value"), F.lower("v").alias("value_normalized")]
    return [F.col("v").alias("value")] if kind == "number" else [F.col("v.*")]


def shred(resources: DataFrame, params: list[SearchParam]) -> DataFrame:
    """Index rows of parameters of one kind and type; repeated values of a resource count once."""
    kinds = {p.kind for p in params}
    if len(kinds) != 1:
        raise ValueError("parameters of one kind are shredded together")
    kind = kinds.pop()

    def named(p: SearchParam) -> Column:
        return F.transform(extract(resources, p), lambda v: F.struct(F.lit(p.code).alias("parameter_name"), v.alias("v")))

    rows = [named(p) for p in params]
    both = F.array_distinct(rows[0] if len(rows) == 1 else F.concat(*rows))
    flat = resources.select(*KEYS, F.explode(both).alias("row")).select(*KEYS, "row.parameter_name", F.col("row.v").alias("v"))
    return flat.filter(F.col("v").isNotNull()).select(*KEYS, "parameter_name", *_values(kind))


def index_all(resources: DataFrame, params: list[SearchParam]) -> dict[str, DataFrame]:
    """Index DataFrames by kind; composites apart, as their columns differ."""
    out: dict[str, DataFrame] = {}
    for kind in sorted({p.kind for p in params}):
        own = [p for p in params if p.kind == kind]
        if kind == "composite":
            out |= {f"composite:{p.code}": shred(resources, [p]) for p in own}
        else:
            out[kind] = shred(resources, own)
    return out


def write_index(index: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One folder for each kind, partitioned by type and parameter, sorted by id within files."""
    for kind, df in index.items():
        df.repartition("resource_type", "parameter_name", "id").sortWithinPartitions("id").write.mode(mode).partitionBy("resource_type", "parameter_name").parquet(f"{path}/{kind.replace(':', '-')}")


def identifier_types(resources: DataFrame, field: str = "identifier") -> DataFrame:
    """Rows for :of-type: the codings of an identifier's type with its value."""
    one = resources.select(*KEYS, F.explode(f"resource.{field}").alias("i")).select(*KEYS, F.explode("i.type.coding").alias("c"), F.col("i.value").alias("value"))
    return one.select(*KEYS, F.col("c.system").alias("type_system"), F.col("c.code").alias("type_code"), F.lower("c.code").alias("type_code_ci"), "value", F.lower("value").alias("value_ci"))


def reference_identifiers(resources: DataFrame, param: SearchParam) -> DataFrame:
    """Token rows of the identifiers that references of a parameter hold instead of, or besides, a target."""
    v = compile_expression(f"({param.expression}).identifier", F.col("resource"), resources.schema["resource"].dataType)
    rows = resources.select(*KEYS, F.explode(_each(v, lambda x: _token(x, v.type))).alias("v"))
    return rows.select(*KEYS, F.lit(param.code).alias("parameter_name"), "v.*")


def narrative(resource: str, t: T.DataType) -> Column:
    """The narrative of a resource without its markup; null where its type has none."""
    if "text" in _fields(t) and "div" in _fields(t["text"].dataType):
        return tx.strip_html(F.col(f"{resource}.text.div"))
    return F.lit(None).cast("string")


def narrative_text(resources: DataFrame) -> DataFrame:
    """The _text index: a narrative without its markup."""
    content = narrative("resource", resources.schema["resource"].dataType)
    return resources.select(*KEYS, F.lit("_text").alias("parameter_name"), content.alias("content")).filter("content IS NOT NULL")


# The parts of names and addresses, and the elements that hold text wherever they occur.
NAME_PARTS = ("family", "given", "prefix", "suffix")
ADDRESS_PARTS = ("line", "city", "district", "state", "postalCode", "country")
TEXT_PARTS = ("text", "display")


def _texts(x: Column, t: T.DataType, also: tuple[str, ...] = ()) -> Column | None:
    """The texts anywhere in a value, as an array: text and display elements, parts of names and addresses, contacts."""
    if isinstance(t, T.ArrayType):
        if _texts(x, t.elementType) is None:
            return None
        return F.coalesce(F.flatten(F.transform(x, lambda y: _texts(y, t.elementType))), F.array().cast("array<string>"))
    if not isinstance(t, T.StructType):
        return None
    names = set(t.fieldNames())
    wanted = {*TEXT_PARTS, *also}
    if {"family", "given"} & names:
        wanted |= set(NAME_PARTS)
    elif names & set(ADDRESS_PARTS):
        wanted |= set(ADDRESS_PARTS)
    elif {"system", "value"} <= names:
        wanted |= {"value"}
    parts = []
    for f in t.fields:
        y = x.getField(f.name)
        if isinstance(f.dataType, T.StringType):
            parts += [F.array(y)] if f.name in wanted else []
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            parts += [F.coalesce(y, F.array().cast("array<string>"))] if f.name in wanted else []
        elif (inner := _texts(y, f.dataType)) is not None:
            parts.append(inner)
    return F.concat(*parts) if parts else None


def content(resource: str, t: T.DataType, *also: str) -> Column:
    """All text of a resource: the narrative, then other texts in their order, each once, joined by blanks."""
    found = _texts(F.col(resource), t, also)
    parts = F.array(narrative(resource, t))
    parts = parts if found is None else F.concat(parts, found)
    return F.array_join(F.filter(F.array_distinct(F.array_compact(parts)), lambda p: F.trim(p) != ""), " ")


#: Elements of a resource itself that count as text besides those of any type.
OWN_TEXT = ("description", "name", "title", "action")


def content_text(resources: DataFrame, *also: str) -> DataFrame:
    """The _content index: all text of a resource, and the elements of its own that are named."""
    made = content("resource", resources.schema["resource"].dataType, *(also or OWN_TEXT))
    return resources.select(*KEYS, F.lit("_content").alias("parameter_name"), made.alias("content"))


def memberships(resources: DataFrame, field: str = "member", reference: str = "entity") -> DataFrame:
    """Edges from a collection to its members, with whether a membership is inactive."""
    one = resources.select("resource_type", "id", F.explode(f"resource.{field}").alias("m"))
    ref = parse_reference(F.col(f"m.{reference}.reference"))
    return one.select(F.col("resource_type").alias("collection_type"), F.col("id").alias("collection_id"), ref["target_type"].alias("member_type"), ref["target_id"].alias("member_id"), F.coalesce(F.col("m.inactive"), F.lit(False)).alias("member_inactive"))


def stale_entries(index: DataFrame, current: DataFrame) -> DataFrame:
    """Index rows whose version is no longer the current one."""
    return index.join(current.select(*KEYS), list(KEYS), "left_anti")


def with_entry_hash(index: DataFrame) -> DataFrame:
    """The index with a hash of each row's values, by which rows are kept once."""
    values = [c for c in index.columns if c not in KEYS]
    return index.withColumn("entry_hash", F.md5(F.to_json(F.struct(*values)).cast("binary"))).dropDuplicates([*KEYS, "entry_hash"])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
