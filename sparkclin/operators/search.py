"""Search: conditions become filters on the resources, or semi- and anti-joins with index rows.

A request is resolved on the driver (catalogue, prefixes, modifiers, ranges); what runs is one lazy DataFrame. Without a
stored index a condition on a resource's own values is a filter on its row: it tests whether any of the parameter's
values satisfies it, so a request of many such conditions is one scan without a shuffle. With a stored index it is a
semi-join with the index rows. Chains, reverse chains and value sets are joins in both cases.
"""

from __future__ import annotations

import base64
import json
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.fhirpath.compiler import compile_expression
from sparkclin.functions import text as tx
from sparkclin.functions.temporal import search_range
from sparkclin.operators import hierarchy, indexing
from sparkclin.plans.catalog import COMPARTMENTS, MANDATORY, MODIFIERS, PREFIXES, SUMMARY, Catalog, SearchError, SearchParam
from sparkclin.plans.request import DEFAULT_COUNT, Condition, Request, age_to_birthdate, parse_filter, parse_request, parse_text_query, split_escaped, split_prefix

UCUM = "http://unitsofmeasure.org"
MAX_PASSES = 3


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


# value clauses: what a value must satisfy; ``of`` gives its columns by name, of an index row or of an array's element


def string_clause(value: str, modifier: str | None = None, of=F.col) -> Column:
    if modifier == "exact":
        return of("value") == value
    if modifier == "text":
        return tx.matches_query(of("value"), parse_text_query(value))
    folded = F.lit(tx.normalize_text(value))
    return F.contains(of("value_normalized"), folded) if modifier == "contains" else F.startswith(of("value_normalized"), folded)


def token_clause(value: str, modifier: str | None = None, of=F.col) -> Column:
    """``code``, ``system|code``, ``|code`` (no system) and ``system|``; codes match in any case but those of UCUM."""
    if modifier in ("text", "code-text"):
        return F.startswith(F.lower(of("display" if modifier == "text" else "code")), F.lit(value.lower()))
    if modifier == "text-advanced":
        return tx.matches_query(of("display"), parse_text_query(value))
    if "|" not in value:
        return of("code_ci") == value.lower()
    system, code = value.split("|", 1)
    same = of("system").isNull() if system == "" else of("system") == system
    if not code:
        return same
    return same & ((of("code") == code) if system == UCUM else (of("code_ci") == code.lower()))


def date_clause(value: str, of=F.col) -> Column:
    """The interval algebra of the prefixes on the half-open ranges of the value and the row."""
    prefix, text = split_prefix(value)
    low, high = search_range(text)
    s, e = F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")
    lo, hi = of("start_date"), of("end_date")
    if prefix == "ap":
        width = (F.unix_micros(e) - F.unix_micros(s)) * F.lit(0.1)
        slack = F.greatest(width, F.lit(86_400_000_000.0)).cast("long")
        return (F.unix_micros(lo) < F.unix_micros(e) + slack) & (F.unix_micros(hi) > F.unix_micros(s) - slack)
    return {
        "eq": (lo >= s) & (hi <= e), "ne": (hi <= s) | (lo >= e), "gt": hi > e, "ge": hi > s,
        "lt": lo < s, "le": lo < e, "sa": lo >= e, "eb": hi <= s, "po": (lo < e) & (hi > s),
    }[prefix]


def number_range(text: str) -> tuple[Decimal, Decimal, Decimal]:
    """The value and the half-open range that its written precision implies."""
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise SearchError(f"not a number: {text!r}") from None
    half = Decimal(5).scaleb(value.as_tuple().exponent - 1)
    return value, value - half, value + half


def number_clause(value: str, of=F.col) -> Column:
    prefix, text = split_prefix(value)
    number, low, high = number_range(text)
    v, lo, hi = of("value"), F.lit(float(low)), F.lit(float(high))
    if prefix == "ap":
        return F.abs(v - F.lit(float(number))) <= F.lit(float(max(abs(number) / 10, high - number)))
    return {"eq": (v >= lo) & (v < hi), "ne": (v < lo) | (v >= hi), "gt": v >= hi, "sa": v >= hi, "ge": v >= lo, "lt": v < lo, "eb": v < lo, "le": v < hi}[prefix]


def quantity_clause(value: str, of=F.col) -> Column:
    """``number``, ``number|system|code`` or ``number||code`` (code or unit); units are not converted."""
    parts = split_escaped(value, "|")
    out = number_clause(parts[0], of)
    if len(parts) == 3:
        if parts[1]:
            out = out & (of("system") == parts[1]) & (of("code") == parts[2])
        elif parts[2]:
            out = out & ((of("code") == parts[2]) | (of("unit") == parts[2]))
    return out


def version_key(column: Column) -> Column:
    """A dotted version as an array of six numbers, so that versions compare by number."""
    parts = F.transform(F.split(column, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 6)), 1, 6)


def reference_clause(value: str, targets: tuple[str, ...] = (), modifier: str | None = None, of=F.col) -> Column:
    """``modifier`` is a target type, or how texts of the reference are compared, or whose versions of a canonical count."""
    if modifier == "text":
        return F.startswith(F.lower(of("display")), F.lit(value.lower()))
    if modifier == "text-advanced":
        return tx.matches_query(of("display"), parse_text_query(value))
    if modifier == "code-text":
        return _any([F.coalesce(F.startswith(F.lower(of(c)), F.lit(value.lower())), F.lit(False)) for c in ("target_type", "target_id", "target_url")])
    if value.startswith("#"):
        return (of("reference_kind") == "fragment") & (of("target_id") == value[1:])
    linked = F.coalesce(of("reference_kind") != "fragment", F.lit(False))
    if "://" in value or value.startswith("urn:"):
        url, _, version = value.partition("|")
        same = of("target_url") == url
        if not version:
            return same
        if modifier in ("above", "below"):
            have, want = version_key(of("canonical_version")), version_key(F.lit(version))
            return same & of("canonical_version").isNotNull() & (have >= want if modifier == "above" else have <= want)
        return same & ((of("canonical_version") == version) | F.startswith(of("canonical_version"), F.lit(version + ".")))
    parts = value.split("/")
    if len(parts) >= 4 and parts[-2] == "_history":
        return (of("target_type") == parts[-4]) & (of("target_id") == parts[-3]) & (of("target_version_id") == parts[-1])
    if len(parts) >= 2:
        return (of("target_type") == parts[-2]) & (of("target_id") == parts[-1])
    same = linked & (of("target_id") == value)
    allowed = (modifier,) if modifier else targets
    return same & of("target_type").isin(*allowed) if allowed else same


def uri_clause(value: str, modifier: str | None = None, of=F.col) -> Column:
    base, v = value.rstrip("/"), of("value")
    if modifier == "contains":
        return F.contains(F.lower(v), F.lit(value.lower()))
    if modifier == "below":
        return (v == value) | F.startswith(v, F.lit(base + "/"))
    if modifier == "above":
        return (v == value) | F.startswith(F.lit(value), F.concat(F.rtrim(v, F.lit("/")), F.lit("/")))
    return v == value


def value_clause(param_kind: str, value: str, modifier: str | None = None, targets: tuple[str, ...] = (), of=F.col) -> Column:
    """The clause of a value for a parameter, or a component, of a kind."""
    if param_kind == "string":
        return string_clause(value, modifier, of)
    if param_kind == "token":
        return token_clause(value, None if modifier == "not" else modifier, of)
    if param_kind == "reference":
        return reference_clause(value, targets, modifier, of)
    if param_kind == "uri":
        return uri_clause(value, modifier, of)
    return {"date": date_clause, "number": number_clause, "quantity": quantity_clause}[param_kind](value, of)


def _exists(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _elements(kind: str, values: Column, folded: bool) -> tuple[Column, object]:
    """Index values of a parameter as an array to test, and how the columns of an element are got."""
    if kind == "string" and folded:
        return F.arrays_zip(values.alias("value"), tx.normalize_all(values).alias("value_normalized")), lambda x: x.getField
    if kind in ("string", "number", "uri"):
        return values, lambda x: lambda name: x
    return values, lambda x: x.getField


class Store:
    """Resources by type, the catalogue, and indexes made (or read) on demand."""

    def __init__(self, frames: dict[str, DataFrame], catalog: Catalog | None = None, index_path: str | None = None):
        self.frames, self.catalog, self.index_path = frames, catalog or Catalog.default(), index_path
        self.expansions: dict[str, DataFrame] = {}
        self.members: DataFrame | None = None
        self._index: dict[tuple[str, str], DataFrame] = {}

    @classmethod
    def from_tables(cls, spark, sf_dir: str, *types: str) -> Store:
        from sparkclin.sources.tables import MAKERS

        return cls({t: MAKERS[t](spark, sf_dir) for t in types or MAKERS})

    def resources(self, kind: str) -> DataFrame:
        if kind not in self.frames:
            raise SearchError(f"no resources of type {kind}")
        df = self.frames[kind]
        if "deleted" in df.columns:
            from sparkclin.operators.history import current

            df = current(df)
        return df

    def param(self, kind: str, code: str) -> SearchParam:
        found = self.catalog.find(kind, code)
        if found is None:
            raise SearchError(f"{kind} has no search parameter {code}")
        return found

    def index(self, kind: str, code: str) -> DataFrame:
        if (kind, code) not in self._index:
            param = self.param(kind, code)
            if self.index_path:
                name = f"composite-{code}" if param.kind == "composite" else param.kind
                df = self.frames[kind].sparkSession.read.parquet(f"{self.index_path}/{name}").filter((F.col("resource_type") == kind) & (F.col("parameter_name") == code))
            else:
                df = indexing.shred(self.resources(kind), [param])
            self._index[kind, code] = df
        return self._index[kind, code]

    def names(self, kind: str, code: str) -> SearchParam | None:
        return self.catalog.find(kind, code)


class Search:
    """Evaluates requests over a store."""

    def __init__(self, store: Store, today: str | None = None):
        self.store, self.today = store, today

    def own(self, kind: str, c: Condition) -> Column | None:
        """A condition on a resource's own values as a predicate of its row; null where it takes a join or a stored index."""
        if c.reverse or c.chain or self.store.index_path and c.code not in ("_id", "_lastUpdated"):
            return None
        rows = self.store.resources(kind)
        schema = rows.schema["resource"].dataType
        if c.code == "_id":
            return F.col("id").isin(*c.values)
        if c.code == "_lastUpdated":
            at = F.col("last_updated")
            stamp = {"start_date": at, "end_date": at + F.expr("INTERVAL 1 MICROSECOND")}
            return _any([date_clause(v, stamp.__getitem__) for v in c.values])
        if c.code in ("_text", "_content"):
            text = indexing.narrative("resource", schema) if c.code == "_text" else indexing.content("resource", schema, *indexing.OWN_TEXT)
            return _any([tx.matches_query(text, parse_text_query(v)) for v in c.values])
        if c.code in ("_in", "_list") or c.code == "age" and self.store.names(kind, "age") is None:
            return None
        param = self.checked(kind, c)
        if self.joins(param, c):
            return None
        if param.kind == "composite" and c.modifier != "missing":
            return self.own_composite(rows, param, c)
        values = indexing.extract(rows, param)
        if c.modifier == "missing":
            return (F.coalesce(F.size(values), F.lit(0)) > 0) != F.lit(c.values[0] == "true")
        array, of = _elements(param.kind, values, c.modifier not in ("exact", "text"))
        found = _exists(array, lambda x: _any([value_clause(param.kind, v, c.modifier, param.targets, of(x)) for v in c.values]))
        return ~found if param.kind == "token" and c.modifier == "not" else found

    def own_composite(self, rows: DataFrame, param: SearchParam, c: Condition) -> Column:
        """Some group has, for each component, a value that satisfies its part; tuples are not built."""
        groups = compile_expression(param.expression, F.col("resource"), rows.schema["resource"].dataType)
        wanted = [self.parts(param, v) for v in c.values]

        def one(g: Column, part: str, expression: str, kind: str) -> Column:
            array, of = _elements(kind, indexing.component_values(g, groups.type, expression, kind), False)
            return _exists(array, lambda x: value_clause(kind, part, None, (), self.folded(of(x), kind)))

        def test(g: Column) -> Column:
            each = [[one(g, part, expression, kind) for part, (_, expression, kind) in zip(parts, param.components)] for parts in wanted]
            return _any([reduce(lambda a, b: a & b, tests) for tests in each])

        return _exists(groups.array().column, test)

    @staticmethod
    def folded(of, kind: str):
        """Columns of a string component: folded by built-in functions, as no Python runs inside a lambda."""
        return (lambda name: tx.normalize_native(of("value")) if name == "value_normalized" else of(name)) if kind == "string" else of

    def checked(self, kind: str, c: Condition) -> SearchParam:
        param = self.store.param(kind, c.code)
        if c.modifier and c.modifier != "missing" and c.modifier not in MODIFIERS[param.kind] and not (param.kind == "reference" and c.modifier[0].isupper()):
            raise SearchError(f"modifier :{c.modifier} does not fit {c.code}")
        return param

    @staticmethod
    def joins(param: SearchParam, c: Condition) -> bool:
        """Whether a modifier looks beyond the resource itself."""
        if param.kind == "token":
            return c.modifier in ("in", "not-in", "above", "below", "of-type")
        if param.kind == "reference" and c.modifier in ("above", "below"):
            return not all("|" in v for v in c.values)  # versions of a canonical are compared in the row
        return param.kind == "reference" and c.modifier in ("contains", "identifier")

    # ids that satisfy one condition, and whether they are to be taken out instead
    def ids(self, kind: str, c: Condition) -> tuple[DataFrame, bool]:
        if c.reverse:
            return self.reverse(kind, c.reverse, c), False
        if c.chain:
            return self.chain(kind, c), False
        if c.code in ("_text", "_content"):
            return self.text(kind, c), False
        if c.code in ("_in", "_list"):
            return self.member_ids(kind, c), False
        if c.code == "age" and self.store.names(kind, "age") is None and self.store.names(kind, "birthdate"):
            return self.age(kind, c), False
        param = self.checked(kind, c)
        if c.modifier == "missing":
            return self.store.index(kind, c.code).select("id"), c.values[0] == "true"
        if param.kind == "token" and c.modifier in ("in", "not-in"):
            return self.expansion(kind, c), c.modifier == "not-in"
        if param.kind == "token" and c.modifier in ("above", "below"):
            return self.code_hierarchy(kind, c), False
        if param.kind == "token" and c.modifier == "of-type":
            return self.of_type(kind, c), False
        if self.joins(param, c) and c.modifier != "identifier":
            return self.reference_hierarchy(kind, param, c), False
        if param.kind == "reference" and c.modifier == "identifier":
            rows = indexing.reference_identifiers(self.store.resources(kind), param)
            return rows.filter(_any([token_clause(v) for v in c.values])).select("id"), False
        rows = self.store.index(kind, c.code).filter(self.clause(param, c)).select("id")
        return rows, param.kind == "token" and c.modifier == "not"

    def clause(self, param: SearchParam, c: Condition) -> Column:
        """The clause of a condition on the rows of a parameter's index."""
        if param.kind == "composite":
            return _any([self.composite_clause(param, v) for v in c.values])
        return _any([value_clause(param.kind, v, c.modifier, param.targets) for v in c.values])

    def parts(self, param: SearchParam, value: str) -> list[str]:
        parts = split_escaped(value, "$")
        if len(parts) != len(param.components):
            raise SearchError(f"{param.code} needs {len(param.components)} parts")
        return parts

    def composite_clause(self, param: SearchParam, value: str) -> Column:
        out = F.lit(True)
        for k, (part, (_, _, kind)) in enumerate(zip(self.parts(param, value), param.components)):
            plain = kind in ("string", "number", "uri")
            of = (lambda name, k=k: F.col(f"c{k}")) if plain else (lambda name, k=k: F.col(f"c{k}.{name}"))
            out = out & value_clause(kind, part, None, (), self.folded(of, kind))
        return out

    def age(self, kind: str, c: Condition) -> DataFrame:
        """An age is searched as a range of birth dates."""
        from datetime import datetime, timezone

        today = self.today or datetime.now(timezone.utc).date().isoformat()
        found = []
        for v in c.values:
            rows = self.store.resources(kind)
            for test in age_to_birthdate(v, today):
                rows = self.apply(rows, kind, Condition("birthdate", None, (test,)))
            found.append(rows.select("id"))
        return reduce(DataFrame.unionByName, found)

    def text(self, kind: str, c: Condition) -> DataFrame:
        resources = self.store.resources(kind)
        rows = indexing.narrative_text(resources) if c.code == "_text" else indexing.content_text(resources)
        return rows.filter(_any([tx.matches_query(F.col("content"), parse_text_query(v)) for v in c.values])).select("id")

    def member_ids(self, kind: str, c: Condition) -> DataFrame:
        """Members of collections; for _in only those whose membership is active."""
        if self.store.members is None:
            raise SearchError("the store has no collections")
        names = [v.rpartition("/")[2] for v in c.values]
        rows = self.store.members.filter((F.col("member_type") == kind) & F.col("collection_id").isin(*names))
        if c.code == "_in":
            rows = rows.filter(~F.col("member_inactive"))
        return rows.select(F.col("member_id").alias("id"))

    def expansion(self, kind: str, c: Condition) -> DataFrame:
        """Rows whose code is in the full expansion of a value set, by a join instead of a list of values."""
        codes = reduce(DataFrame.unionByName, [self.value_set(v).select("system", "code") for v in c.values]).distinct()
        rows = self.store.index(kind, c.code)
        return rows.join(codes, (rows["code"] == codes["code"]) & (codes["system"].isNull() | rows["system"].eqNullSafe(codes["system"])), "left_semi").select("id")

    def value_set(self, url: str) -> DataFrame:
        if url not in self.store.expansions:
            raise SearchError(f"unknown value set {url}")
        return self.store.expansions[url]

    def code_hierarchy(self, kind: str, c: Condition) -> DataFrame:
        """Codes above or below a code in the hierarchy of its code system (columns child, parent of ``expansions``)."""
        wanted = []
        for v in c.values:
            system, _, code = v.rpartition("|")
            edges = self.store.expansions.get(f"hierarchy:{system}")
            if edges is None:
                raise SearchError(f"no hierarchy of {system}")
            start = edges.sparkSession.range(1).select(F.lit(code).alias("id"))
            source, target = ("child", "parent") if c.modifier == "above" else ("parent", "child")
            wanted.append(hierarchy.reachable(edges, start, source, target).select(F.lit(system).alias("system"), F.col("id").alias("code")))
        codes = reduce(DataFrame.unionByName, wanted)
        rows = self.store.index(kind, c.code)
        return rows.join(codes, ["system", "code"], "left_semi").select("id")

    def of_type(self, kind: str, c: Condition) -> DataFrame:
        rows = indexing.identifier_types(self.store.resources(kind))
        tests = []
        for v in c.values:
            system, code, value = split_escaped(v, "|")
            tests.append((F.col("type_system") == system) & (F.col("type_code_ci") == code.lower()) & (F.col("value_ci") == value.lower()))
        return rows.filter(_any(tests)).select("id")

    def reference_hierarchy(self, kind: str, param: SearchParam, c: Condition) -> DataFrame:
        """References to what is above, below or both of a resource along its own part-of references."""
        if len(param.targets) != 1:
            raise SearchError(f":{c.modifier} needs a single target type")
        target = param.targets[0]
        link = next((p for p in self.store.catalog.of_type(target, "reference") if target in p.targets), None)
        if link is None:
            raise SearchError(f"{target} has no hierarchy")
        edges = self.store.index(target, link.code).select(F.col("id").alias("child"), F.col("target_id").alias("parent"))
        start = edges.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v.rpartition("/")[2]) for v in c.values])).alias("id"))
        down = lambda: hierarchy.reachable(edges, start, "parent", "child").select("id")
        up = lambda: hierarchy.reachable(edges, start, "child", "parent").select("id")
        found = down() if c.modifier == "below" else up() if c.modifier == "above" else down().unionByName(up()).distinct()
        if kind == target and param.code == link.code:
            return found
        rows = self.store.index(kind, c.code)
        return rows.join(found.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("id")

    def chain_targets(self, kind: str, c: Condition) -> DataFrame:
        """(target_type, target_id) of what satisfies the rest of a chain, for each target type that knows its parameter."""
        param = self.store.param(kind, c.code)
        if param.kind != "reference":
            raise SearchError(f"{c.code} is no reference")
        head, *rest = c.chain
        code, _, modifier = head.partition(":")
        found = []
        for target in [c.target] if c.target else param.targets:
            if target not in self.store.frames or code != "_id" and self.store.names(target, code) is None:
                continue
            inner = Condition(code, None, c.values, tuple(rest), modifier or None) if rest else Condition(code, modifier or None, c.values)
            ids = self.apply(self.store.resources(target), target, inner)
            found.append(ids.select(F.lit(target).alias("target_type"), F.col("id").alias("target_id")))
        if not found:
            raise SearchError(f"no target of {c.code} has {code}")
        return reduce(DataFrame.unionByName, found)

    def chain(self, kind: str, c: Condition) -> DataFrame:
        """Ids of the resources whose references have such targets."""
        return self.store.index(kind, c.code).join(self.chain_targets(kind, c), ["target_type", "target_id"], "left_semi").select("id")

    def reverse(self, kind: str, steps: tuple[tuple[str, str], ...], c: Condition) -> DataFrame:
        """Resources that others which satisfy the condition refer to."""
        (source, reference), *rest = steps
        inner = Condition(c.code, c.modifier, c.values, reverse=tuple(rest))
        matching = self.apply(self.store.resources(source), source, inner)
        if self.store.index_path:
            rows = self.store.index(source, reference).join(matching, "id", "left_semi")
        else:  # the references of what matches are in its rows
            rows = matching.select(F.explode(indexing.extract(matching, self.store.param(source, reference))).alias("r")).select("r.*")
        return rows.filter(F.col("target_type") == kind).select(F.col("target_id").alias("id"))

    def apply(self, rows: DataFrame, kind: str, c: Condition) -> DataFrame:
        """Of ``rows``, which are resources of the type, those that satisfy the condition."""
        own = self.own(kind, c)
        if own is not None:
            return rows.filter(own)
        if c.chain and not self.store.index_path:
            param = self.store.param(kind, c.code)
            link = compile_expression(param.expression, F.col("resource"), rows.schema["resource"].dataType)
            if param.kind == "reference" and not link.many:  # a single reference joins as it stands
                targets = self.chain_targets(kind, c).select(F.col("target_type").alias("__type"), F.col("target_id").alias("__id"))
                return rows.withColumn("__r", F.get(indexing.extract(rows, param), 0)).join(targets, (F.col("__r.target_type") == F.col("__type")) & (F.col("__r.target_id") == F.col("__id")), "left_semi").drop("__r")
        ids, negate = self.ids(kind, c)
        return rows.join(ids, "id", "left_anti" if negate else "left_semi")

    # _filter
    def own_filter(self, kind: str, tree) -> Column | None:
        """A filter whose tests are all on a resource's own values, as a predicate of its row."""
        if tree[0] in ("and", "or"):
            a, b = self.own_filter(kind, tree[1]), self.own_filter(kind, tree[2])
            return None if a is None or b is None else a & b if tree[0] == "and" else a | b
        if tree[0] == "not":
            inner = self.own_filter(kind, tree[1])
            return None if inner is None else ~inner
        _, path, op, value = tree
        if path.startswith("_has:") or "." in path:
            return None
        if path == "_id":
            return self.id_test(op, value)
        if self.store.index_path:
            return None
        param = self.store.param(kind, path)
        if op == "pr":
            return self.own(kind, Condition(path, "missing", ("false" if value == "true" else "true",)))
        test = self.value_test(param, op, value)
        if test is not None:
            values = indexing.extract(self.store.resources(kind), param)
            array, of = _elements(param.kind, values, True)
            found = _exists(array, lambda x: test(of(x)))
            return ~found if op == "ne" and param.kind == "string" else found
        out = self.own(kind, self.as_condition(kind, path, op, value))
        return None if out is None else F.coalesce(out, F.lit(False))

    @staticmethod
    def id_test(op: str, value: str) -> Column:
        if op not in ("eq", "ne"):
            raise SearchError(f"_id has no operator {op}")
        return F.col("id") == value if op == "eq" else F.col("id") != value

    @staticmethod
    def value_test(param: SearchParam, op: str, value: str):
        """Tests that requests have no form for: of whole and ending strings, and of periods that overlap."""
        if param.kind == "string" and op in ("eq", "ne", "co", "sw", "ew"):
            v = F.lit(tx.normalize_text(value))
            how = {"eq": lambda t: t == v, "ne": lambda t: t == v, "co": lambda t: F.contains(t, v), "sw": lambda t: F.startswith(t, v), "ew": lambda t: F.endswith(t, v)}[op]
            return lambda of: how(of("value_normalized"))
        if param.kind == "date" and op == "po":
            low, high = search_range(value)
            return lambda of: (of("start_date") < F.lit(high).cast("timestamp")) & (of("end_date") > F.lit(low).cast("timestamp"))
        return None

    def filter_rows(self, rows: DataFrame, kind: str, tree) -> DataFrame:
        """Of ``rows``, which are resources of the type, those that satisfy the filter."""
        own = self.own_filter(kind, tree)
        return rows.filter(own) if own is not None else rows.join(self.filter_ids(kind, tree), "id", "left_semi")

    def filter_ids(self, kind: str, tree) -> DataFrame:
        own = self.own_filter(kind, tree)
        if own is not None:
            return self.store.resources(kind).filter(own).select("id")
        if tree[0] == "and":
            return self.filter_ids(kind, tree[1]).join(self.filter_ids(kind, tree[2]), "id", "left_semi")
        if tree[0] == "or":
            return self.filter_ids(kind, tree[1]).unionByName(self.filter_ids(kind, tree[2])).distinct()
        if tree[0] == "not":
            return self.store.resources(kind).select("id").join(self.filter_ids(kind, tree[1]), "id", "left_anti")
        _, path, op, value = tree
        return self.filter_test(kind, path, op, value)

    def filter_test(self, kind: str, path: str, op: str, value: str) -> DataFrame:
        resources = self.store.resources(kind)
        all_ids = resources.select("id")
        if path.startswith("_has:"):
            *steps, code = path.split(":")[1:]
            pairs = tuple(zip(steps[0::2], steps[1::2]))
            return self.reverse(kind, pairs, self.as_condition(pairs[-1][0], code, op, value)).distinct()
        if "." in path:
            head, _, rest = path.partition(".")
            head, _, inner = head.partition("[")
            param = self.store.param(kind, head)
            found = []
            for target in param.targets:
                rows = self.filter_rows(self.store.resources(target), target, ("test", rest, op, value))
                if inner:
                    rows = self.filter_rows(rows, target, parse_filter(inner.rstrip("]")))
                found.append(rows.select(F.lit(target).alias("target_type"), F.col("id").alias("target_id")))
            return self.store.index(kind, head).join(reduce(DataFrame.unionByName, found), ["target_type", "target_id"], "left_semi").select("id").distinct()
        param = self.store.param(kind, path)
        rows = self.store.index(kind, path)
        if op == "pr":
            ids = rows.select("id").distinct()
            return ids if value == "true" else all_ids.join(ids, "id", "left_anti")
        test = self.value_test(param, op, value)
        if test is not None:
            ids = rows.filter(test(F.col)).select("id").distinct()
            return all_ids.join(ids, "id", "left_anti") if op == "ne" else ids
        return self.apply(resources, kind, self.as_condition(kind, path, op, value)).select("id")

    def as_condition(self, kind: str, code: str, op: str, value: str) -> Condition:
        """A test as a condition of the URL form; the parameter's type comes from the catalogue."""
        param = self.store.param(kind, code)
        modifiers = {"in": "in", "ni": "not-in", "ss": "above", "sb": "below"}
        if param.kind in ("date", "number", "quantity") and op in PREFIXES:
            return Condition(code, None, (op + value,))
        if op in modifiers and modifiers[op] in MODIFIERS[param.kind]:
            return Condition(code, modifiers[op], (value,))
        if op == "eq" or op == "re" and param.kind == "reference":
            return Condition(code, None, (value,))
        if op == "ne" and param.kind == "token":
            return Condition(code, "not", (value,))
        if op == "co" and param.kind in ("string", "uri", "token"):
            return Condition(code, "text" if param.kind == "token" else "contains", (value,))
        if op == "sw" and param.kind == "string":
            return Condition(code, None, (value,))
        raise SearchError(f"operator {op} does not fit {code}")

    # requests
    def matches(self, request: Request | str, kind: str | None = None) -> DataFrame:
        """All resources of the type that satisfy the conditions, unsorted and unlimited."""
        r = parse_request(request) if isinstance(request, str) else request
        kind = kind or r.resource
        rows = self.store.resources(kind)
        order = {"_id": 0, "token": 1, "reference": 2}
        rank = lambda c: order.get(c.code, order.get(p.kind, 3) if (p := self.store.names(kind, c.code)) else 3)
        for c in sorted(r.conditions, key=rank):
            rows = self.apply(rows, kind, c)
        for f in r.filters:
            rows = self.filter_rows(rows, kind, parse_filter(f))
        return rows

    def sort_keys(self, rows: DataFrame, kind: str, sort: list[tuple[str, bool]]) -> tuple[DataFrame, list[tuple[str, bool]]]:
        """``rows`` with a column for each sort key: the least value a resource has for the parameter."""
        keys = []
        for k, (code, down) in enumerate(sort or [("_lastUpdated", True), ("_id", True)]):
            name = f"sort_{k}"
            if code in ("_id", "_lastUpdated"):
                rows = rows.withColumn(name, F.col("id" if code == "_id" else "last_updated"))
            else:
                param = self.store.param(kind, code)
                value = {"string": "value", "uri": "value", "number": "value", "quantity": "value", "date": "start_date", "token": "code", "reference": "target_id"}.get(param.kind)
                if value is None:
                    raise SearchError(f"{code} cannot be sorted by")
                if self.store.index_path or "resource" not in rows.columns:
                    least = self.store.index(kind, code).groupBy("id").agg(F.min(value).alias(name))
                    rows = rows.join(least, "id", "left")
                else:
                    array, of = _elements(param.kind, indexing.extract(rows, param), False)
                    rows = rows.withColumn(name, F.array_min(F.transform(array, lambda x: of(x)(value))))
            keys.append((name, down))
        if not any(code == "_id" for code, _ in sort) and sort:
            rows = rows.withColumn("sort_id", F.col("id"))
            keys.append(("sort_id", False))
        return rows, keys

    def page(self, request: Request | str) -> DataFrame:
        """One page of matches in order, with the sort columns. A cursor continues after the row whose keys it holds."""
        r = parse_request(request) if isinstance(request, str) else request
        rows, keys = self.sort_keys(self.matches(r), r.resource, r.sort)
        if r.cursor:
            last = json.loads(base64.urlsafe_b64decode(r.cursor))
            rows = rows.filter(self.after(rows, keys, last))
        order = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last() for n, down in keys]
        count = DEFAULT_COUNT if r.count is None else r.count
        rows = rows.orderBy(*order)
        if r.offset:
            rows = rows.offset(r.offset)
        return rows.limit(count)

    @staticmethod
    def after(rows: DataFrame, keys: list[tuple[str, bool]], last: list) -> Column:
        """Rows behind the given sort keys; a null key is behind all others."""
        out, same = F.lit(False), F.lit(True)
        for (name, down), value in zip(keys, last):
            c = F.col(name)
            v = F.lit(value).cast(rows.schema[name].dataType)
            beyond = F.lit(False) if value is None else (c < v if down else c > v) | c.isNull()
            out = out | (same & beyond)
            same = same & c.eqNullSafe(v)
        return out

    @staticmethod
    def cursor(row, keys: list[tuple[str, bool]]) -> str:
        return base64.urlsafe_b64encode(json.dumps([None if row[n] is None else row[n] if isinstance(row[n], (int, float, str)) else str(row[n]) for n, _ in keys]).encode()).decode()

    def total(self, request: Request | str) -> DataFrame:
        return self.matches(request).agg(F.count(F.lit(1)).alias("total"))

    def includes(self, keys: DataFrame, request: Request) -> DataFrame:
        """(resource_type, id, mode) of the matches and what _include and _revinclude add, with iteration up to a bound."""
        seen = keys.select("resource_type", "id").distinct()
        out = seen.withColumn("mode", F.lit("match"))
        frontier = seen
        rules = [("include", v) for v in request.include] + [("revinclude", v) for v in request.revinclude]
        for k in range(MAX_PASSES if request.iterate else 1):
            found = [self.step(frontier, direction, v) for direction, v in (rules if k == 0 else []) + request.iterate]
            if not found:
                break
            fresh = reduce(DataFrame.unionByName, found).distinct().join(seen, ["resource_type", "id"], "left_anti")
            if request.iterate:
                fresh = hierarchy.materialize(fresh)
                if fresh.isEmpty():
                    break
            out = out.unionByName(fresh.withColumn("mode", F.lit("include")))
            seen, frontier = seen.unionByName(fresh), fresh
        return out

    def step(self, keys: DataFrame, direction: str, rule: str) -> DataFrame:
        source, code, *kind = rule.split(":")
        params = self.store.catalog.of_type(source, "reference") if code == "*" else [self.store.param(source, code)]
        out = []
        for p in params:
            rows = self.store.index(source, p.code)
            if kind:
                rows = rows.filter(F.col("target_type") == kind[0])
            if direction == "include":
                hit = rows.join(keys.select("resource_type", "id"), ["resource_type", "id"], "left_semi").select(F.col("target_type").alias("resource_type"), F.col("target_id").alias("id"))
                known = [self.store.resources(t).select("resource_type", "id") for t in p.targets if t in self.store.frames]
                if known:
                    hit = hit.join(reduce(DataFrame.unionByName, known), ["resource_type", "id"], "left_semi")
            else:
                to = keys.select(F.col("resource_type").alias("target_type"), F.col("id").alias("target_id"))
                hit = rows.join(to, ["target_type", "target_id"], "left_semi").select("resource_type", "id")
            out.append(hit)
        return reduce(DataFrame.unionByName, out).distinct()

    def search(self, url: str) -> DataFrame:
        """(resource_type, id, mode) of a request's page and includes."""
        r = parse_request(url)
        page = self.page(r).select("resource_type", "id")
        return self.includes(page, r) if r.include or r.revinclude or r.iterate else page.withColumn("mode", F.lit("match"))

    def system(self, url: str) -> DataFrame:
        """(resource_type, id) over several types (_type); a parameter must exist for all of them."""
        r = parse_request(url)
        return reduce(DataFrame.unionByName, [self.matches(r, t).select("resource_type", "id") for t in r.types or sorted(self.store.frames)])

    def compartment(self, kind: str, ident: str, resource: str) -> DataFrame:
        """Resources in a compartment: the resource itself, or what refers to it by a membership parameter."""
        rules = COMPARTMENTS.get(kind, {}).get(resource, ())
        rows = self.store.resources(resource)
        if not rules:
            return rows.filter(F.lit(False))
        found = []
        for code in rules:
            if code == "{def}":
                found.append(F.col("id") == ident)
            else:
                found.append(self.own(resource, Condition(code, None, (f"{kind}/{ident}",))))
        if all(test is not None for test in found):
            return rows.filter(_any(found))
        index = [self.store.index(resource, c).filter((F.col("target_type") == kind) & (F.col("target_id") == ident)).select("id") if c != "{def}" else rows.filter(F.col("id") == ident).select("id") for c in rules]
        return rows.join(reduce(DataFrame.unionByName, index), "id", "left_semi")

    def everything(self, ident: str, kind: str = "Patient", types: list[str] | None = None, since: str | None = None) -> DataFrame:
        """(resource_type, id) of a resource and its whole compartment."""
        wanted = [t for t in COMPARTMENTS[kind] if t in self.store.frames and (not types or t in types)]
        rows = reduce(DataFrame.unionByName, [self.compartment(kind, ident, t).select("resource_type", "id", "last_updated") for t in wanted])
        return (rows.filter(F.col("last_updated") >= since) if since else rows).select("resource_type", "id")

    def bundle(self, url: str) -> dict:
        """A searchset of one page: entries, total and the link to the next page."""
        r = parse_request(url)
        rows, keys = self.sort_keys(self.matches(r), r.resource, r.sort)
        page = self.page(r)
        shown = subset(page, r) if r.summary or r.elements else page
        entries = shown.select("resource_type", "id", F.to_json("resource").alias("json"), *[n for n, _ in keys]).collect()
        out = {"resourceType": "Bundle", "type": "searchset", "link": [{"relation": "self", "url": url}], "entry": [{"resource": json.loads(e["json"]), "search": {"mode": "match"}} for e in entries]}
        if r.total == "accurate" or r.summary == "count":
            out["total"] = rows.count()
        if entries and len(entries) == (r.count or DEFAULT_COUNT):
            base = "&".join(p for p in url.split("&") if not p.startswith("_cursor="))
            out["link"].append({"relation": "next", "url": f"{base}&_cursor={self.cursor(entries[-1], keys)}"})
        return out


def subset(rows: DataFrame, request: Request) -> DataFrame:
    """Resources cut to the elements that _summary or _elements ask for, tagged as such."""
    fields = rows.schema["resource"].dataType.fieldNames()
    if request.elements:
        wanted = [*MANDATORY, *request.elements]
    elif request.summary == "true":
        kind = request.resource or ""
        wanted = [*MANDATORY, *SUMMARY.get(kind, fields)]
    elif request.summary == "text":
        wanted = [*MANDATORY, "text"]
    elif request.summary == "data":
        wanted = [f for f in fields if f != "text"]
    elif request.summary == "count":
        return rows.limit(0)
    else:
        return rows
    keep = [F.col(f"resource.{f}").alias(f) for f in fields if f in wanted]
    tag = F.struct(F.array(F.struct(F.lit("SUBSETTED").alias("code"))).alias("tag")).alias("meta")
    return rows.withColumn("resource", F.struct(*keep, tag))
