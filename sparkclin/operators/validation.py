"""Validation of typed resources, and snapshots of profiles.

Every step gives issues (id, severity, code, path, message); a run is their union. Steps are Column predicates over
the resources, so all resources are validated in one pass per step.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclin.fhirpath.compiler import NotCompilable, Typed, compile_expression
from sparkclin.operators.indexing import parse_reference

ISSUE = ("id", "severity", "code", "path", "message")

# Formats of the primitive types.
PRIMITIVES = {
    "boolean": r"^(true|false)$", "integer": r"^-?(0|[1-9]\d*)$", "positiveInt": r"^[1-9]\d*$", "unsignedInt": r"^(0|[1-9]\d*)$",
    "decimal": r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$", "id": r"^[A-Za-z0-9\-.]{1,64}$", "code": r"^[^\s]+( [^\s]+)*$",
    "uri": r"^\S*$", "url": r"^\S*$", "canonical": r"^\S*$", "oid": r"^urn:oid:[0-2](\.(0|[1-9]\d*))+$",
    "uuid": r"^urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "date": r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?$", "time": r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?$",
    "dateTime": r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d\d:\d\d))?)?)?$",
}


@dataclass
class Element:
    """A rule for the values at a path: how many, of what primitive type, and what they must equal or contain."""

    path: str
    min: int = 0
    max: int | None = None
    type: str | None = None
    fixed: str | None = None
    pattern: str | None = None
    binding: tuple[str, str] | None = None  # value set, strength
    max_length: int | None = None


@dataclass
class Invariant:
    key: str
    path: str
    expression: str
    severity: str = "error"
    best_practice: bool = False


@dataclass
class Slice:
    """A slice of the items at ``path``: those for which ``discriminator`` holds (kind: value, pattern, exists)."""

    name: str
    path: str
    discriminator: str
    value: str | None = None
    kind: str = "value"
    min: int = 0
    max: int | None = None


@dataclass
class Profile:
    elements: list[Element] = field(default_factory=list)
    invariants: list[Invariant] = field(default_factory=list)
    slices: list[Slice] = field(default_factory=list)
    closed: tuple[str, ...] = ()
    overrides: dict[str, str] = field(default_factory=dict)


#: What each preset runs.
PRESETS = {
    "ingestion": ("schema",),
    "authoring": ("schema", "profiles", "constraints"),
    "server": ("schema", "profiles", "slicing", "constraints", "terminology"),
    "publication": ("schema", "profiles", "slicing", "constraints", "terminology", "references"),
}

STRENGTH = {"required": "error", "extensible": "warning", "preferred": "information", "example": "information"}


def _at(df: DataFrame, path: str) -> Typed:
    return compile_expression(path, F.col("resource"), df.schema["resource"].dataType)


def _issues(df: DataFrame, rules: list[tuple[Column, str, str, str, str]]) -> DataFrame:
    """Rows for the rules that fail: (test, severity, code, path, message), all rules in one pass."""
    each = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(p).alias("path"), F.lit(m).alias("message"))) for test, s, c, p, m in rules]
    if not each:
        return df.select("id", F.lit("").alias("severity"), F.lit("").alias("code"), F.lit("").alias("path"), F.lit("").alias("message")).limit(0)
    return df.select("id", F.explode(F.array_compact(F.array(*each))).alias("i")).select("id", "i.*")


def schema_step(df: DataFrame, profile: Profile) -> DataFrame:
    """Cardinality, primitive formats and lengths."""
    rules = []
    malformed = lambda items, kind: F.exists(items, lambda x: ~x.cast("string").rlike(PRIMITIVES[kind]))
    longer = lambda items, n: F.exists(items, lambda x: F.length(x.cast("string")) > n)
    for e in profile.elements:
        v = _at(df, e.path)
        items = v.array().column
        n = F.size(items)
        if e.min:
            rules.append((n < e.min, "error", "required", e.path, f"at least {e.min} expected"))
        if e.max is not None:
            rules.append((n > e.max, "error", "structure", e.path, f"at most {e.max} allowed"))
        if e.type in PRIMITIVES:
            rules.append((malformed(items, e.type), "error", "value", e.path, f"not a {e.type}"))
        if e.max_length is not None:
            rules.append((longer(items, e.max_length), "error", "value", e.path, f"longer than {e.max_length}"))
    return _issues(df, rules)


def unknown_elements(raw: DataFrame, known: list[str], column: str = "json") -> DataFrame:
    """Issues for top-level fields of JSON texts that the type does not have."""
    keys = raw.select("id", F.explode(F.json_object_keys(column)).alias("key")).filter(~F.col("key").isin("resourceType", "id", "meta", *known) & ~F.col("key").startswith("_"))
    return keys.select("id", F.lit("error").alias("severity"), F.lit("structure").alias("code"), F.col("key").alias("path"), F.lit("unknown element").alias("message"))


def profile_step(df: DataFrame, profile: Profile) -> DataFrame:
    """Fixed values must be equal; patterns must be contained."""
    rules = []
    same = lambda value: lambda x: x.cast("string") == value
    other = lambda value: lambda x: x.cast("string") != value
    for e in profile.elements:
        items = _at(df, e.path).array().column
        if e.fixed is not None:
            rules.append((F.exists(items, other(e.fixed)), "error", "value", e.path, f"must be {e.fixed}"))
        if e.pattern is not None:
            rules.append(((F.size(items) > 0) & ~F.exists(items, same(e.pattern)), "error", "value", e.path, f"must include {e.pattern}"))
    return _issues(df, rules)


def slicing_step(df: DataFrame, profile: Profile) -> DataFrame:
    """How many items each slice holds; of closed slicings, items that no slice takes."""
    rules, taken = [], {}

    def slice_test(s: Slice, v: Typed):
        def test(x: Column) -> Column:
            found = compile_expression(s.discriminator, x, v.type).array().column
            if s.kind == "exists":
                return F.size(found) > 0
            return F.coalesce(F.exists(found, lambda y: y.cast("string") == s.value), F.lit(False))

        return test

    def untaken(tests):
        return lambda x: ~reduce(lambda a, b: a | b, [t(x) for t in tests], F.lit(False))

    for s in profile.slices:
        v = _at(df, s.path).array()
        test = slice_test(s, v)
        n = F.size(F.filter(v.column, test))
        taken.setdefault(s.path, []).append(test)
        if s.min:
            rules.append((n < s.min, "error", "structure", f"{s.path}:{s.name}", f"at least {s.min} expected"))
        if s.max is not None:
            rules.append((n > s.max, "error", "structure", f"{s.path}:{s.name}", f"at most {s.max} allowed"))
    for path in profile.closed:
        tests = taken.get(path, [])
        items = _at(df, path).array().column
        rules.append((F.exists(items, untaken(tests)), "error", "structure", path, "no slice takes this item"))
    return _issues(df, rules)


def constraint_step(df: DataFrame, profile: Profile, best_practice: str = "warning") -> DataFrame:
    """Invariants: expressions that must not be false; on a path they are tested for each item there."""
    rules = []
    broken = lambda c, v: lambda x: ~F.coalesce(compile_expression(c.expression, x, v.type).scalar().column, F.lit(False))
    for c in profile.invariants:
        severity = profile.overrides.get(c.key) or (best_practice if c.best_practice else c.severity)
        if severity == "ignore":
            continue
        if c.path in ("", "$this"):
            holds = _at(df, c.expression).scalar().column
            fails = ~F.coalesce(holds, F.lit(False))
        else:
            v = _at(df, c.path).array()
            fails = F.exists(v.column, broken(c, v))
        rules.append((fails, severity, "invariant", c.path, c.key))
    return _issues(df, rules)


def terminology_step(df: DataFrame, profile: Profile, expansions: dict[str, DataFrame]) -> DataFrame:
    """Codes that the bound value set does not hold, by the strength of the binding.

    Codings and concepts are compared with their system, where the value set names systems; a plain code by itself.
    Of a concept one coding in the value set is enough.
    """
    out = []
    for e in profile.elements:
        if e.binding is None:
            continue
        url, strength = e.binding
        v, members = _at(df, e.path).array(), expansions[url]
        names = set(v.type.fieldNames()) if isinstance(v.type, T.StructType) else set()
        null = F.lit(None).cast("string")

        def coding(c: Column, of: set[str]) -> Column:
            return F.struct((c.getField("system") if "system" in of else null).alias("system"), c.getField("code").alias("code"))

        if "coding" in names:
            inner = set(v.type["coding"].dataType.elementType.fieldNames())
            items = F.transform(v.column, lambda x: F.transform(x.getField("coding"), lambda c: coding(c, inner)))
        elif "code" in names:
            items = F.transform(v.column, lambda x: F.array(coding(x, names)))
        else:
            items = F.transform(v.column, lambda x: F.array(F.struct(null.alias("system"), x.cast("string").alias("code"))))
        items = df.select("id", F.posexplode(items).alias("item", "codings"))
        codes = items.select("id", "item", F.explode_outer("codings").alias("c")).select("id", "item", "c.system", "c.code")
        known = members.select(F.col("code").alias("__code"), (F.col("system") if "system" in members.columns else null).alias("__system"), F.lit(True).alias("__in")).distinct()
        same = (F.col("code") == F.col("__code")) & (F.col("system").isNull() | F.col("__system").isNull() | (F.col("system") == F.col("__system")))
        each = codes.join(known, same, "left").groupBy("id", "item").agg(F.coalesce(F.bool_or("__in"), F.lit(False)).alias("ok"), F.min("code").alias("code"))
        bad = each.filter("NOT ok AND code IS NOT NULL")
        out.append(bad.select("id", F.lit(STRENGTH[strength]).alias("severity"), F.lit("code-invalid").alias("code"), F.lit(e.path).alias("path"), F.concat(F.lit("not in the value set: "), "code").alias("message")))
    return reduce(DataFrame.unionByName, out) if out else _issues(df, [])


def reference_step(df: DataFrame, paths: list[str], targets: DataFrame) -> DataFrame:
    """References to resources that do not exist (targets: resource_type, id)."""
    out = []
    for path in paths:
        refs = df.select("id", F.explode(_at(df, f"{path}.reference").array().column).alias("r"))
        parsed = refs.select("id", "r", parse_reference(F.col("r")).alias("p")).filter("p.reference_kind = 'relative'")
        known = targets.select(F.col("resource_type").alias("tt"), F.col("id").alias("ti"))
        bad = parsed.join(known, (F.col("p.target_type") == F.col("tt")) & (F.col("p.target_id") == F.col("ti")), "left_anti")
        out.append(bad.select("id", F.lit("error").alias("severity"), F.lit("not-found").alias("code"), F.lit(path).alias("path"), F.concat(F.lit("unknown: "), "r").alias("message")))
    return reduce(DataFrame.unionByName, out)


def validate(df: DataFrame, profile: Profile, preset: str = "server", expansions: dict[str, DataFrame] | None = None, targets: DataFrame | None = None, references: list[str] | None = None, max_issues: int | None = None) -> DataFrame:
    """All issues of a preset's steps."""
    steps = PRESETS[preset]
    parts = []
    if "schema" in steps:
        parts.append(schema_step(df, profile))
    if "profiles" in steps:
        parts.append(profile_step(df, profile))
    if "slicing" in steps:
        parts.append(slicing_step(df, profile))
    if "constraints" in steps:
        parts.append(constraint_step(df, profile))
    if "terminology" in steps and expansions:
        parts.append(terminology_step(df, profile, expansions))
    if "references" in steps and targets is not None and references:
        parts.append(reference_step(df, references, targets))
    out = reduce(DataFrame.unionByName, [p.select(*ISSUE) for p in parts])
    return out.limit(max_issues) if max_issues is not None else out


# snapshots: metadata of a profile, on the driver

_TIGHTNESS = ["example", "preferred", "extensible", "required"]


def merge_element(base: dict, diff: dict, is_slice: bool = False) -> dict:
    """An element of the base restricted by one of the differential."""
    out = copy.deepcopy(base)
    for key, value in diff.items():
        if key == "min":
            out["min"] = value if is_slice else max(value, base.get("min", 0))
        elif key == "max":
            if is_slice:
                out["max"] = value
            else:
                bound = lambda m: float("inf") if m in (None, "*") else int(m)
                out["max"] = value if bound(value) <= bound(base.get("max", "*")) else base.get("max", "*")
        elif key == "binding" and "binding" in base:
            old, new = base["binding"].get("strength", "example"), value.get("strength", "example")
            if _TIGHTNESS.index(new) < _TIGHTNESS.index(old):
                raise ValueError(f"{diff.get('path')}: a binding cannot be loosened from {old} to {new}")
            out["binding"] = {**base["binding"], **value}
        elif key in ("constraint", "mapping", "alias"):
            out[key] = base.get(key, []) + [v for v in value if v not in base.get(key, [])]
        else:
            out[key] = copy.deepcopy(value)
    return out


def snapshot(base: list[dict], differential: list[dict]) -> list[dict]:
    """The base's elements with the differential applied; slices and children of complex elements are put in place."""
    out = [copy.deepcopy(e) for e in base]
    where = {e.get("id", e["path"]): k for k, e in enumerate(out)}
    for d in differential:
        ident = d.get("id", d["path"])
        if ident in where:
            out[where[ident]] = merge_element(out[where[ident]], d)
            continue
        parent = next((e for e in out if e.get("id", e["path"]) == ident.split(":")[0]), None)
        made = merge_element({k: v for k, v in (parent or {"path": d["path"]}).items() if k != "slicing"}, d, is_slice=":" in ident)
        made["id"] = ident
        prefix = ident.rpartition(".")[0] if ":" not in ident.rpartition(".")[2] else ident.split(":")[0]
        at = max((k for k, e in enumerate(out) if e.get("id", e["path"]) == prefix or e.get("id", e["path"]).startswith((prefix + ".", prefix + ":"))), default=len(out) - 1)
        out.insert(at + 1, made)
        where = {e.get("id", e["path"]): k for k, e in enumerate(out)}
    return out


def differential(base: list[dict], full: list[dict]) -> list[dict]:
    """What a snapshot adds to its base."""
    old = {e.get("id", e["path"]): e for e in base}
    out = []
    for e in full:
        b = old.get(e.get("id", e["path"]))
        if b is None:
            out.append(copy.deepcopy(e))
        elif changed := {k: v for k, v in e.items() if k not in ("id", "path") and b.get(k) != v}:
            out.append({"id": e.get("id", e["path"]), "path": e["path"], **changed})
    return out


def expand_choice(element: dict) -> list[dict]:
    """A choice element (name[x]) as one element for each of its types."""
    if not element["path"].endswith("[x]"):
        return [element]
    stem = element["path"][:-3]
    return [{**element, "path": stem + t["code"][:1].upper() + t["code"][1:], "type": [t], "min": 0} for t in element.get("type", [])]


def expand_content_reference(elements: list[dict]) -> list[dict]:
    """Elements that refer to another's content get its children."""
    out = []
    for e in elements:
        out.append(e)
        if ref := e.get("contentReference"):
            source = ref.lstrip("#")
            for x in elements:
                if x["path"].startswith(source + ".") and "contentReference" not in x:
                    out.append({**copy.deepcopy(x), "path": e["path"] + x["path"][len(source) :], "id": e.get("id", e["path"]) + x["path"][len(source) :]})
    return out


__all__ = ["Element", "Invariant", "NotCompilable", "Profile", "Slice", "snapshot", "validate"]
