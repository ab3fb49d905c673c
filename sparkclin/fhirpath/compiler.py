"""Compiles FHIRPath to Columns over a typed resource.

The compiler tracks for every node its Spark type and whether it holds one item or many: single items stay scalars
(NULL is the empty collection), collections are arrays. Predicates use SQL's three-valued logic, which has the same
tables. What Columns cannot express raises NotCompilable, and ``apply`` then falls back to the interpreter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclin.fhirpath.parser import FhirPathError, parse
from sparkclin.functions.temporal import parse_temporal


class NotCompilable(FhirPathError):
    """The expression is valid but has no Column form."""


@dataclass(frozen=True)
class Typed:
    """A compiled node. ``temporal``: date, dateTime or time for texts that hold one. ``variants``: of a choice element."""

    column: Column
    type: T.DataType
    many: bool = False
    temporal: str | None = None
    variants: dict = field(default_factory=dict, hash=False, compare=False)
    unit: str | None = None

    def scalar(self) -> Typed:
        """At most one item; more are an error, as in the language."""
        if not self.many:
            return self
        c = F.when(F.size(self.column) > 1, F.raise_error(F.lit("a single item was expected"))).otherwise(F.get(self.column, 0))
        return Typed(c, self.type, False, self.temporal)

    def array(self) -> Typed:
        if self.many:
            return Typed(F.coalesce(self.column, F.array().cast(T.ArrayType(self.type))), self.type, True, self.temporal)
        empty = F.array().cast(T.ArrayType(self.type))
        return Typed(F.when(self.column.isNull(), empty).otherwise(F.array(self.column)), self.type, True, self.temporal)


LONG, STRING, BOOL, DOUBLE, DECIMAL = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.DecimalType(38, 10)
NUMBERS = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.DecimalType, T.ShortType)


def _whole(t: T.DataType) -> bool:
    return isinstance(t, (T.LongType, T.IntegerType, T.ShortType))


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMBERS)


@dataclass(frozen=True)
class Scope:
    this: Typed
    index: Column | None = None
    total: Typed | None = None


#: Functions added by register_function: name to a builder from (input, *arguments) to a result.
REGISTERED: dict[str, Callable[..., Typed]] = {}


def register_function(name: str, builder: Callable[..., Typed]) -> None:
    REGISTERED[name] = builder


class Compiler:
    def __init__(self, root: Typed, variables: dict[str, Column] | None = None):
        self.root, self.variables = root, variables or {}

    def compile(self, expression: str) -> Typed:
        return self.node(parse(expression), Scope(self.root))

    # navigation
    def child(self, of: Typed, name: str) -> Typed:
        if not isinstance(of.type, T.StructType):
            raise NotCompilable(f"{name} of {of.type.simpleString()}")
        fields = {f.name: f.dataType for f in of.type.fields}
        if name in fields:
            return self.step(of, name, fields[name])
        variants = {n[len(name) :]: self.step(of, n, t) for n, t in fields.items() if n.startswith(name) and n[len(name) : len(name) + 1].isupper()}
        if not variants:
            raise NotCompilable(f"no field {name} in {of.type.simpleString()[:80]}")
        first = next(iter(variants.values()))
        same = [v for v in variants.values() if v.type == first.type and v.many == first.many]
        if len(same) == len(variants):
            column = F.coalesce(*[v.column for v in same]) if len(same) > 1 else first.column
            return Typed(column, first.type, first.many, first.temporal, variants)
        return Typed(first.column, first.type, first.many, first.temporal, variants)

    def step(self, of: Typed, name: str, kind: T.DataType) -> Typed:
        temporal = "date" if name in ("birthDate", "date") else "dateTime" if name.endswith(("DateTime", "Instant")) or name in ("start", "end", "issued", "authored", "lastUpdated", "recorded") else None
        if not of.many:
            inner = of.column.getField(name)
            return Typed(inner, kind.elementType, True, temporal) if isinstance(kind, T.ArrayType) else Typed(inner, kind, False, temporal)
        inner = F.filter(F.transform(of.column, lambda x: x.getField(name)), lambda x: x.isNotNull())
        if isinstance(kind, T.ArrayType):
            return Typed(F.filter(F.flatten(inner), lambda x: x.isNotNull()), kind.elementType, True, temporal)
        return Typed(inner, kind, True, temporal)

    def node(self, t, s: Scope) -> Typed:
        kind = t[0]
        if kind == "lit":
            return self.literal(t[1], t[2])
        if kind == "list":
            if not t[1]:
                return Typed(F.lit(None).cast("string"), STRING)
            out = self.node(t[1][0], s)
            for e in t[1][1:]:
                out = self.union(out, self.node(e, s))
            return out
        if kind == "name":
            if s.this is self.root and self.is_root_type(t[1]):
                return s.this
            return self.child(s.this, t[1])
        if kind == "dot":
            left, right = self.node(t[1], s), t[2]
            if right[0] == "name":
                return self.child(left, right[1])
            if right[0] == "var":
                return self.node(right, s)
            return self.call(right[1], right[2], left, s)
        if kind == "call":
            return self.call(t[1], t[2], s.this, s)
        if kind == "index":
            left, i = self.node(t[1], s).array(), self.node(t[2], s).scalar()
            return Typed(F.get(left.column, i.column.cast("int")), left.type, False, left.temporal)
        if kind == "var":
            if t[1] == "$this":
                return s.this
            if t[1] == "$index" and s.index is not None:
                return Typed(s.index.cast("long"), LONG)
            if t[1] == "$total" and s.total is not None:
                return s.total
            raise NotCompilable(t[1])
        if kind == "env":
            if t[1] in ("resource", "context", "rootResource"):
                return self.root
            fixed = {"ucum": "http://unitsofmeasure.org", "sct": "http://snomed.info/sct", "loinc": "http://loinc.org"}
            if t[1] in fixed:
                return Typed(F.lit(fixed[t[1]]), STRING)
            if t[1] in self.variables:
                return Typed(self.variables[t[1]], STRING)
            raise FhirPathError(f"unknown variable %{t[1]}")
        if kind == "unary":
            v = self.node(t[2], s).scalar()
            if not _numeric(v.type):
                raise NotCompilable("a sign of something that is no number")
            return v if t[1] == "+" else Typed(F.try_subtract(F.lit(0).cast(v.type), v.column), v.type, unit=v.unit)
        if kind == "type":
            if t[1] == "is":
                return self.call("is", (("name", t[3]),), self.node(t[2], s), s)
            return self.call("ofType", (("name", t[3]),), self.node(t[2], s), s)
        return self.binary(t[1], self.node(t[2], s), self.node(t[3], s))

    def is_root_type(self, name: str) -> bool:
        names = {f.name for f in self.root.type.fields} if isinstance(self.root.type, T.StructType) else set()
        return name[:1].isupper() and name not in names

    def literal(self, kind: str, v) -> Typed:
        if kind == "string":
            return Typed(F.lit(v), STRING)
        if kind == "boolean":
            return Typed(F.lit(v), BOOL)
        if kind == "integer":
            return Typed(F.lit(v).cast("long"), LONG)
        if kind == "decimal":
            return Typed(F.lit(v).cast(DECIMAL), DECIMAL)
        if kind in ("date", "dateTime", "time"):
            value = parse_temporal(v, kind)
            if value is None:
                raise FhirPathError(f"not a {kind}: {v}")
            return Typed(F.lit(value.text()), STRING, False, kind)
        if kind == "quantity":
            return Typed(F.lit(v[0]).cast(DECIMAL), DECIMAL, unit=v[1])
        raise NotCompilable(kind)

    # operators
    @staticmethod
    def align(a: Typed, b: Typed) -> tuple[Column, Column, T.DataType]:
        """Both sides as one numeric type: long, else decimal, else double."""
        if _whole(a.type) and _whole(b.type):
            kind = LONG
        elif isinstance(a.type, (T.DoubleType, T.FloatType)) or isinstance(b.type, (T.DoubleType, T.FloatType)):
            kind = DOUBLE
        else:
            kind = DECIMAL
        return a.column.cast(kind), b.column.cast(kind), kind

    def truth(self, v: Typed) -> Column:
        v = v.scalar()
        return v.column if isinstance(v.type, T.BooleanType) else F.when(v.column.isNotNull(), F.lit(True))

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("and", "or", "xor", "implies"):
            p, q = self.truth(a), self.truth(b)
            out = {"and": lambda: p & q, "or": lambda: p | q, "xor": lambda: p != q, "implies": lambda: ~p | q}[op]()
            return Typed(out, BOOL)
        if op == "|":
            return self.union(a, b)
        if op in ("in", "contains"):
            item, among = (a, b) if op == "in" else (b, a)
            item, among = item.scalar(), among.array()
            found = F.coalesce(F.array_contains(F.filter(among.column, lambda x: x.isNotNull()), item.column.cast(among.type)), F.lit(False)) if item.type == among.type or _numeric(item.type) and _numeric(among.type) else F.lit(False)
            return Typed(F.when(item.column.isNotNull(), found), BOOL)
        if op in ("=", "!="):
            out = self.equals(a, b)
            return Typed(out if op == "=" else ~out, BOOL)
        if op in ("~", "!~"):
            x, y = (F.array_sort(F.transform(self.folded(v.array()).column, lambda e: e)) for v in (a, b))
            out = x == y
            return Typed(out if op == "~" else ~out, BOOL)
        a, b = a.scalar(), b.scalar()
        if op == "&":
            text = [F.coalesce(self.to_text(v), F.lit("")) for v in (a, b)]
            return Typed(F.concat(*text), STRING)
        if op in ("<", "<=", ">", ">="):
            return Typed(self.order(op, a, b), BOOL)
        if op == "+" and isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType) and not a.temporal:
            return Typed(F.concat(a.column, b.column), STRING)
        if a.temporal in ("date", "dateTime") and b.unit and op in "+-":
            return self.move(a, b, op)
        if not (_numeric(a.type) and _numeric(b.type)) or a.unit or b.unit:
            raise NotCompilable(f"{op} of {a.type.simpleString()} and {b.type.simpleString()}")
        x, y, kind = self.align(a, b)
        if op in "+-*":
            return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y).cast(kind), kind)
        if op == "/":
            kind = DOUBLE if kind == DOUBLE else DECIMAL
            return Typed(F.try_divide(x.cast(kind), y.cast(kind)).cast(kind), kind)
        if op == "div":
            return Typed(F.when(y != 0, F.call_function("div", x, y) if kind == LONG else F.try_divide(x, y).cast("long")), LONG)
        return Typed(F.try_mod(x, y), kind)

    def move(self, a: Typed, b: Typed, op: str) -> Typed:
        n = b.column.cast("int") * (1 if op == "+" else -1)
        unit = {"d": "day", "wk": "week"}.get(b.unit, b.unit)
        days = {"day": 1, "week": 7}
        day = F.try_to_date(F.rpad(a.column, 10, "-01-01") if a.temporal == "date" else F.substring(a.column, 1, 10))
        if unit in days:
            moved = F.date_add(day, n * days[unit])
        elif unit in ("month", "year"):
            moved = F.add_months(day, n * (12 if unit == "year" else 1))
        else:
            raise NotCompilable(f"a date moved by {b.unit}")
        text = moved.cast("string")
        size = F.length(a.column)
        return Typed(F.when(size <= 10, F.substring(text, F.lit(1), size)).otherwise(F.concat(text, F.substring(a.column, 11, 30))), STRING, False, a.temporal)

    @staticmethod
    def instant(v: Typed) -> Column:
        """A date text that compares as text: with a zone it is moved to UTC."""
        zoned = v.column.rlike(r"T.*(Z|[+-]\d\d:\d\d)$")
        moved = F.date_format(F.try_to_timestamp(v.column), "yyyy-MM-dd'T'HH:mm:ss.SSS")
        return F.when(zoned, moved).otherwise(F.when(v.column.rlike(r"T\d\d:\d\d:\d\d$"), F.concat(v.column, F.lit(".000"))).otherwise(v.column))

    def prefix_order(self, a: Typed, b: Typed) -> tuple[Column, Column, Column]:
        """The texts cut to the coarser precision, and whether the precisions agree."""
        x, y = self.instant(a), self.instant(b)
        n = F.least(F.length(x), F.length(y))
        return F.substring(x, F.lit(1), n), F.substring(y, F.lit(1), n), F.length(x) == F.length(y)

    def order(self, op: str, a: Typed, b: Typed) -> Column:
        test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        if a.temporal or b.temporal:
            x, y, same = self.prefix_order(a, b)
            return F.when(x != y, test(x, y)).when(same, test(x, y))
        if _numeric(a.type) and _numeric(b.type) and a.unit == b.unit:
            x, y, _ = self.align(a, b)
            return test(x, y)
        if isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
            return test(a.column, b.column)
        raise NotCompilable(f"{op} of {a.type.simpleString()} and {b.type.simpleString()}")

    def equals(self, a: Typed, b: Typed) -> Column:
        if a.many or b.many:
            x, y = a.array(), b.array()
            if _numeric(x.type) and _numeric(y.type):
                kind = self.align(x, y)[2]
                x, y = (Typed(F.transform(v.column, lambda e: e.cast(kind)), kind, True) for v in (x, y))
            if x.type != y.type:
                return F.when((F.size(x.column) > 0) & (F.size(y.column) > 0), F.lit(False))
            return F.when((F.size(x.column) > 0) & (F.size(y.column) > 0), x.column == y.column)
        if a.temporal or b.temporal:
            x, y, same = self.prefix_order(a, b)
            return F.when(x != y, F.lit(False)).when(same, F.lit(True))
        if _numeric(a.type) and _numeric(b.type) and a.unit == b.unit:
            x, y, _ = self.align(a, b)
            return x == y
        if a.type == b.type and a.unit == b.unit:
            return a.column == b.column
        if a.unit or b.unit:
            raise NotCompilable("equality of quantities")
        return F.when(a.column.isNotNull() & b.column.isNotNull(), F.lit(False))

    def folded(self, v: Typed) -> Typed:
        if isinstance(v.type, T.StringType):
            return Typed(F.transform(v.column, lambda e: F.regexp_replace(F.lower(F.trim(e)), r"\s+", " ")), v.type, True)
        if _numeric(v.type):
            return Typed(F.transform(v.column, lambda e: e.cast("double")), DOUBLE, True)
        return v

    def union(self, a: Typed, b: Typed) -> Typed:
        x, y, kind = self.pair(a, b)
        both = F.when(F.size(x) == 0, y).when(F.size(y) == 0, x).otherwise(F.array_union(x, y))
        return Typed(both, kind, True, a.temporal)

    def pair(self, a: Typed, b: Typed) -> tuple[Column, Column, T.DataType]:
        """Two collections as arrays of one type."""
        kind = a.type
        if a.type != b.type:
            if not (_numeric(a.type) and _numeric(b.type)):
                raise NotCompilable("a collection of mixed types")
            kind = self.align(a, b)[2]
        x, y = a.array().column, b.array().column
        return x.cast(T.ArrayType(kind)), y.cast(T.ArrayType(kind)), kind

    def to_text(self, v: Typed) -> Column:
        if isinstance(v.type, T.StructType):
            raise NotCompilable("an object as text")
        return v.column.cast("string")

    # functions
    def call(self, name: str, args, c: Typed, s: Scope) -> Typed:
        special = getattr(self, "f_" + name, None)
        if special is not None:
            return special(c, args, s)
        values = [self.node(a, s) for a in args]
        if name in REGISTERED:
            return REGISTERED[name](c, *values)
        if name in STRING_FUNCTIONS:
            v = c.scalar()
            if not isinstance(v.type, T.StringType):
                raise NotCompilable(f"{name}() of {v.type.simpleString()}")
            column, kind, many = STRING_FUNCTIONS[name](v.column, *[a.scalar().column for a in values])
            return Typed(column, kind, many)
        if name in MATH_FUNCTIONS:
            v = c.scalar()
            if not _numeric(v.type):
                raise NotCompilable(f"{name}() of {v.type.simpleString()}")
            column, kind = MATH_FUNCTIONS[name](v.column, v.type, *[a.scalar().column for a in values])
            return Typed(column, kind)
        if name in CONVERSIONS:
            v = c.scalar()
            column, kind, temporal = CONVERSIONS[name](v.column, v.type)
            return Typed(column, kind, False, temporal)
        if name.startswith("convertsTo") and "to" + name[10:] in CONVERSIONS and name != "convertsToBoolean":
            v = c.scalar()
            return Typed(F.when(v.column.isNotNull(), CONVERSIONS["to" + name[10:]](v.column, v.type)[0].isNotNull()), BOOL)
        if name not in COLLECTION_FUNCTIONS:
            raise NotCompilable(f"{name}()")
        return COLLECTION_FUNCTIONS[name](self, c, *values)

    def predicate(self, tree, s: Scope, of: Typed):
        def test(x: Column, i: Column) -> Column:
            inner = self.node(tree, Scope(Typed(x, of.type, False, of.temporal), i, s.total))
            return F.coalesce(self.truth(inner), F.lit(False))

        return test

    def f_where(self, c, args, s):
        v = c.array()
        return Typed(F.filter(v.column, self.predicate(args[0], s, v)), v.type, True, v.temporal)

    def f_select(self, c, args, s):
        v, seen = c.array(), []

        def one(x: Column, i: Column) -> Column:
            r = self.node(args[0], Scope(Typed(x, v.type, False, v.temporal), i, s.total))
            seen.append(r)
            return r.array().column

        out = F.flatten(F.transform(v.column, one))
        return Typed(F.filter(out, lambda x: x.isNotNull()), seen[-1].type, True, seen[-1].temporal)

    def f_all(self, c, args, s):
        v = c.array()
        test = self.predicate(args[0], s, v)
        if "$index" in repr(args[0]):
            return Typed(F.size(F.filter(v.column, lambda x, i: ~test(x, i))) == 0, BOOL)
        return Typed(F.forall(v.column, lambda x: test(x, F.lit(0))), BOOL)

    def f_exists(self, c, args, s):
        v = c.array()
        if not args:
            return Typed(F.size(v.column) > 0, BOOL) if c.many else Typed(c.column.isNotNull(), BOOL)
        test = self.predicate(args[0], s, v)
        return Typed(F.size(F.filter(v.column, test)) > 0, BOOL)

    def f_iif(self, c, args, s):
        inner = s if c is s.this else Scope(c, s.index, s.total)
        test = F.coalesce(self.truth(self.node(args[0], inner)), F.lit(False))
        a = self.node(args[1], inner)
        if len(args) < 3:
            return Typed(F.when(test, a.column), a.type, a.many, a.temporal)
        b = self.node(args[2], inner)
        if a.many or b.many or a.type != b.type:
            x, y, kind = self.pair(a, b)
            return Typed(F.when(test, x).otherwise(y), kind, True)
        return Typed(F.when(test, a.column).otherwise(b.column), a.type, False, a.temporal)

    def f_aggregate(self, c, args, s):
        v = c.array()
        start = self.node(args[1], s).scalar() if len(args) > 1 else None
        probe = self.node(args[0], Scope(Typed(F.lit(None).cast(v.type), v.type), F.lit(0), start or Typed(F.lit(None).cast(v.type), v.type)))
        kind = probe.type
        zero = start.column.cast(kind) if start is not None else F.lit(None).cast(kind)
        if "$index" in repr(args[0]):
            raise NotCompilable("$index in aggregate()")
        step = lambda acc, x: self.node(args[0], Scope(Typed(x, v.type, False, v.temporal), None, Typed(acc, kind))).scalar().column.cast(kind)
        return Typed(F.aggregate(v.column, zero, step), kind)

    def f_ofType(self, c, args, s):
        name = args[0][1] if args[0][0] == "name" else args[0][2][1]
        if c.variants:
            hit = c.variants.get(name) or c.variants.get(name[:1].upper() + name[1:])
            return hit if hit is not None else Typed(F.lit(None).cast(c.type), c.type, c.many)
        kinds = {"string": T.StringType, "String": T.StringType, "boolean": T.BooleanType, "Boolean": T.BooleanType, "integer": (T.LongType, T.IntegerType), "Integer": (T.LongType, T.IntegerType), "decimal": (T.DoubleType, T.DecimalType), "Decimal": (T.DoubleType, T.DecimalType)}
        if name in kinds:
            return c if isinstance(c.type, kinds[name]) else Typed(F.lit(None).cast(c.type), c.type, c.many)
        if c is self.root:
            test = c.column.getField("resourceType") == name
            return Typed(F.when(test, c.column), c.type)
        raise NotCompilable(f"ofType({name})")

    f_as = f_ofType

    def f_is(self, c, args, s):
        name = args[0][1] if args[0][0] == "name" else args[0][2][1]
        if c is self.root and "resourceType" in c.type.fieldNames():
            return Typed(c.column.getField("resourceType") == name, BOOL)
        of = self.f_ofType(c, args, s)
        present = F.size(of.array().column) > 0 if of.many else of.column.isNotNull()
        any_of = [v.array().column for v in c.variants.values()] or [c.array().column]
        exists = any_of[0].isNull()
        for a in any_of:
            exists = exists | (F.size(a) > 0)
        return Typed(F.when(exists, present), BOOL)

    def f_extension(self, c, args, s):
        url = self.node(args[0], s).scalar().column
        e = self.child(c, "extension").array()
        return Typed(F.filter(e.column, lambda x: x.getField("url") == url), e.type, True)

    def f_trace(self, c, args, s):
        return c

    def f_sort(self, c, args, s):
        v = c.array()
        if not args or args[0] in (("lit", "string", "asc"), ("lit", "string", "desc")):
            return Typed(F.sort_array(v.column, not args or args[0][2] == "asc"), v.type, True, v.temporal)
        tree, down = (args[0][2], True) if args[0][0] == "unary" and args[0][1] == "-" else (args[0], False)
        keyed = F.transform(v.column, lambda x: F.struct(self.node(tree, Scope(Typed(x, v.type, False, v.temporal))).scalar().column.alias("k"), x.alias("v")))
        ordered = F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], F.lit(1 if down else -1)).when(a["k"] > b["k"], F.lit(-1 if down else 1)).otherwise(F.lit(0)))
        return Typed(F.transform(ordered, lambda x: x["v"]), v.type, True)

    def f_repeat(self, c, args, s, depth: int = 8):
        """A typed schema bounds the depth: levels are unrolled until the path no longer exists, deeper ones than ``depth`` not at all."""
        level, out, done = c, None, 0
        while True:
            try:
                level = self.f_select(level, args, s)
            except NotCompilable:
                break
            if done == depth:
                raise NotCompilable("repeat() over many levels")
            if out is not None and out.type != level.type:
                raise NotCompilable("repeat() over changing types")
            out = level if out is None else Typed(F.concat(out.column, level.column), level.type, True)
            done += 1
        if out is None:
            raise NotCompilable("repeat()")
        return Typed(F.array_distinct(out.column), out.type, True)


def _s(column: Column) -> tuple[Column, T.DataType, bool]:
    return column, STRING, False


def _find_last(s: Column, x: Column) -> Column:
    back = F.call_function("instr", F.reverse(s), F.reverse(x))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(s) - F.length(x) - back + 1)


def _substring(s: Column, start: Column, length: Column | None = None) -> tuple:
    inside = (start >= 0) & (start < F.length(s))
    n = F.length(s) if length is None else F.when(length < 0, F.raise_error(F.lit("a length cannot be negative"))).otherwise(length)
    return _s(F.when(inside, F.substring(s, (start + 1).cast("int"), n.cast("int"))))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("\\Q"), x, F.lit("\\E"))


def _nested(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


_HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
_JSON = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def _encode(s: Column, kind: Column) -> tuple:
    raw = F.encode(s, "UTF-8")
    return _s(F.when(kind == "hex", F.lower(F.hex(raw))).when(kind == "base64", F.base64(raw)).when(kind == "urlbase64", F.translate(F.base64(raw), "+/", "-_")))


def _decode(s: Column, kind: Column) -> tuple:
    out = F.when(kind == "hex", F.unhex(s)).when(kind == "base64", F.unbase64(s)).when(kind == "urlbase64", F.unbase64(F.translate(s, "-_", "+/")))
    return _s(F.decode(out, "UTF-8"))


def _escape(s: Column, kind: Column) -> tuple:
    return _s(F.when(kind == "html", _nested(s, _HTML)).when(kind == "json", _nested(s, _JSON)))


def _unescape(s: Column, kind: Column) -> tuple:
    back = lambda pairs: _nested(s, [(b, a) for a, b in reversed(pairs)])
    return _s(F.when(kind == "html", back(_HTML)).when(kind == "json", back(_JSON)))


#: name: builder of (column, type, many) from the string and its arguments.
STRING_FUNCTIONS: dict[str, Callable] = {
    "indexOf": lambda s, x: ((F.call_function("instr", s, x) - 1).cast("long"), LONG, False),
    "lastIndexOf": lambda s, x: (_find_last(s, x).cast("long"), LONG, False),
    "substring": _substring,
    "startsWith": lambda s, x: (F.startswith(s, x), BOOL, False),
    "endsWith": lambda s, x: (F.endswith(s, x), BOOL, False),
    "contains": lambda s, x: (F.contains(s, x), BOOL, False),
    "upper": lambda s: _s(F.upper(s)),
    "lower": lambda s: _s(F.lower(s)),
    "replace": lambda s, a, b: _s(F.when(a == "", F.regexp_replace(s, F.lit(""), b)).otherwise(F.replace(s, a, b))),
    "matches": lambda s, p: (F.rlike(s, F.concat(F.lit("(?s)"), p)), BOOL, False),
    "matchesFull": lambda s, p: (F.rlike(s, F.concat(F.lit("(?s)^(?:"), p, F.lit(")$"))), BOOL, False),
    "replaceMatches": lambda s, p, r: _s(F.regexp_replace(s, F.concat(F.lit("(?s)"), p), r)),
    "length": lambda s: (F.length(s).cast("long"), LONG, False),
    "toChars": lambda s: (F.filter(F.split(s, ""), lambda x: x != ""), STRING, True),
    "trim": lambda s: _s(F.regexp_replace(s, r"^\s+|\s+$", "")),
    "encode": _encode,
    "decode": _decode,
    "escape": _escape,
    "unescape": _unescape,
    "split": lambda s, x: (F.split(s, _quoted(x)), STRING, True),
}


def _real(f):
    return lambda c, t, *a: (f(c.cast("double"), *[x.cast("double") for x in a]), DOUBLE)


def _power(c: Column, t: T.DataType, p: Column) -> tuple:
    real = F.when((c < 0) & (p.cast("double") != F.floor(p.cast("double"))), F.lit(None)).otherwise(F.pow(c.cast("double"), p.cast("double")))
    return (real.cast("long"), LONG) if _whole(t) else (real, DOUBLE)


def _round(c: Column, t: T.DataType, digits: Column | None = None) -> tuple:
    kind = DECIMAL if not isinstance(t, (T.DoubleType, T.FloatType)) else DOUBLE
    n = F.lit(0) if digits is None else digits.cast("int")
    if kind == DOUBLE:
        return F.bround(c.cast(DECIMAL), n).cast("double"), DOUBLE
    return F.bround(c.cast(DECIMAL), n).cast(DECIMAL), DECIMAL


#: name: builder of (column, type) from the number, its type and arguments.
MATH_FUNCTIONS: dict[str, Callable] = {
    "abs": lambda c, t: (F.abs(c), t),
    "ceiling": lambda c, t: (F.ceil(c).cast("long"), LONG),
    "floor": lambda c, t: (F.floor(c).cast("long"), LONG),
    "truncate": lambda c, t: (c.cast("long"), LONG),
    "exp": _real(F.exp),
    "ln": _real(lambda x: F.when(x > 0, F.ln(x))),
    "log": _real(lambda x, b: F.when((x > 0) & (b > 0), F.ln(x) / F.ln(b))),
    "sqrt": _real(lambda x: F.when(x >= 0, F.sqrt(x))),
    "power": _power,
    "round": _round,
}


def _to_boolean(c: Column, t: T.DataType) -> tuple:
    if isinstance(t, T.BooleanType):
        return c, BOOL, None
    if _numeric(t):
        return F.when(c == 1, F.lit(True)).when(c == 0, F.lit(False)), BOOL, None
    w = F.lower(F.trim(c))
    return F.when(w.isin("true", "t", "yes", "y", "1", "1.0"), F.lit(True)).when(w.isin("false", "f", "no", "n", "0", "0.0"), F.lit(False)), BOOL, None


def _to_number(pattern: str, kind: T.DataType):
    def run(c: Column, t: T.DataType) -> tuple:
        if isinstance(t, T.StringType):
            return F.when(F.trim(c).rlike(pattern), F.trim(c).try_cast(kind)), kind, None
        if kind == LONG and _numeric(t) and not _whole(t):
            return F.lit(None).cast(kind), kind, None
        return c.try_cast(kind), kind, None

    return run


def _to_temporal(pattern: str, kind: str, cut: int | None = None):
    def run(c: Column, t: T.DataType) -> tuple:
        if not isinstance(t, T.StringType):
            return F.lit(None).cast("string"), STRING, kind
        value = F.when(c.rlike(pattern), c)
        return (F.substring(value, 1, cut) if cut else value), STRING, kind

    return run


#: name: builder of (column, type, temporal) from a value and its type.
CONVERSIONS: dict[str, Callable] = {
    "toString": lambda c, t: (c.cast("string"), STRING, None),
    "toBoolean": _to_boolean,
    "toInteger": _to_number(r"^[+-]?\d+$", LONG),
    "toDecimal": _to_number(r"^[+-]?\d+(\.\d+)?$", DECIMAL),
    "toDate": _to_temporal(r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T.*)?)?)?$", "date", 10),
    "toDateTime": _to_temporal(r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T(([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?)?(Z|[+-]\d\d:\d\d)?)?)?)?$", "dateTime"),
    "toTime": _to_temporal(r"^T?([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?$", "time"),
}


def _need(c: Typed, kind: type, name: str) -> Typed:
    if not isinstance(c.type, kind):
        raise NotCompilable(f"{name}() of {c.type.simpleString()}")
    return c.array()


def _slice(v: Typed, start: Column, length: Column) -> Typed:
    return Typed(F.slice(v.column, start.cast("int"), F.greatest(length, F.lit(0)).cast("int")), v.type, True, v.temporal)


def _skip(k: Compiler, c: Typed, n: Typed) -> Typed:
    v, by = c.array(), F.greatest(n.scalar().column.cast("int"), F.lit(0))
    return _slice(v, by + 1, F.size(v.column) - by)


def _take(k: Compiler, c: Typed, n: Typed) -> Typed:
    v = c.array()
    return _slice(v, F.lit(1), n.scalar().column.cast("int"))


def _sets(build):
    def run(k: Compiler, c: Typed, o: Typed) -> Typed:
        x, y, kind = k.pair(c, o)
        out = build(x, y)
        return out if isinstance(out, Typed) else Typed(out, kind, True, c.temporal)

    return run


def _low_high(high: bool):
    def run(k: Compiler, c: Typed, digits: Typed | None = None) -> Typed:
        v = c.scalar()
        if isinstance(v.type, T.DecimalType) or _whole(v.type):
            if digits is not None or not _whole(v.type):
                raise NotCompilable("a boundary of a decimal")
            half = F.lit(Decimal("0.5")) if high else F.lit(Decimal("-0.5"))
            return Typed(F.bround(v.column.cast(DECIMAL) + half, 0).cast(DECIMAL), DECIMAL)
        raise NotCompilable("a boundary of a date")

    return run


COLLECTION_FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "not": lambda k, c: Typed(~k.truth(c), BOOL),
    "empty": lambda k, c: Typed(F.size(c.array().column) == 0 if c.many else c.column.isNull(), BOOL),
    "count": lambda k, c: Typed(F.size(c.array().column).cast("long"), LONG),
    "allTrue": lambda k, c: Typed(F.forall(_need(c, T.BooleanType, "allTrue").column, lambda x: x), BOOL),
    "anyTrue": lambda k, c: Typed(F.exists(_need(c, T.BooleanType, "anyTrue").column, lambda x: x), BOOL),
    "allFalse": lambda k, c: Typed(F.forall(_need(c, T.BooleanType, "allFalse").column, lambda x: ~x), BOOL),
    "anyFalse": lambda k, c: Typed(F.exists(_need(c, T.BooleanType, "anyFalse").column, lambda x: ~x), BOOL),
    "distinct": lambda k, c: Typed(F.array_distinct(c.array().column), c.type, True, c.temporal),
    "isDistinct": lambda k, c: Typed(F.size(c.array().column) == F.size(F.array_distinct(c.array().column)), BOOL),
    "single": lambda k, c: c.scalar(),
    "first": lambda k, c: Typed(F.get(c.array().column, 0), c.type, False, c.temporal) if c.many else c,
    "last": lambda k, c: Typed(F.try_element_at(c.array().column, F.lit(-1)), c.type, False, c.temporal) if c.many else c,
    "tail": lambda k, c: _slice(c.array(), F.lit(2), F.size(c.array().column) - 1),
    "skip": _skip,
    "take": _take,
    "subsetOf": _sets(lambda x, y: Typed(F.size(F.array_except(x, y)) == 0, BOOL)),
    "supersetOf": _sets(lambda x, y: Typed(F.size(F.array_except(y, x)) == 0, BOOL)),
    "intersect": _sets(F.array_intersect),
    "exclude": _sets(lambda x, y: F.filter(x, lambda e: ~F.array_contains(y, e))),
    "combine": _sets(lambda x, y: F.concat(x, y)),
    "union": lambda k, c, o: k.union(c, o),
    "join": lambda k, c, sep=None: Typed(F.when(F.size(_need(c, T.StringType, "join").column) > 0, F.array_join(c.array().column, "") if sep is None else F.call_function("array_join", c.array().column, sep.scalar().column)), STRING),
    "hasValue": lambda k, c: Typed((F.size(c.array().column) == 1) & (F.coalesce(F.get(c.array().column, 0).cast("string"), F.lit("")) != ""), BOOL),
    "convertsToString": lambda k, c: Typed(F.when(c.scalar().column.isNotNull(), F.lit(not isinstance(c.type, T.StructType))), BOOL),
    "convertsToBoolean": lambda k, c: Typed(F.when(c.scalar().column.isNotNull(), F.lower(F.trim(c.scalar().column)).isin("true", "false") if isinstance(c.type, T.StringType) else _to_boolean(c.scalar().column, c.type)[0].isNotNull()), BOOL),
    "now": lambda k, c: Typed(F.date_format(F.date_trunc("second", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING, False, "dateTime"),
    "today": lambda k, c: Typed(F.current_date().cast("string"), STRING, False, "date"),
    "timeOfDay": lambda k, c: Typed(F.date_format(F.current_timestamp(), "HH:mm:ss"), STRING, False, "time"),
    "conformsTo": lambda k, c, u: Typed(F.lower(c.scalar().column.getField("resourceType")) == F.lower(F.substring_index(u.scalar().column, "/", -1)), BOOL),
    "lowBoundary": _low_high(False),
    "highBoundary": _low_high(True),
    "precision": lambda k, c: Typed(F.when(F.length(c.scalar().column) <= 10, F.length(F.replace(c.scalar().column, F.lit("-"), F.lit(""))).cast("long")), LONG) if c.temporal == "date" else (_ for _ in ()).throw(NotCompilable("precision()")),
}


def compile_expression(expression: str, column: Column, schema: T.DataType, variables: dict[str, Column] | None = None) -> Typed:
    """The expression over a struct column of the given type."""
    return Compiler(Typed(column, schema), variables).compile(expression)


def apply(df: DataFrame, expression: str, resource: str = "resource", output: str = "result", on_error: str = "raise") -> DataFrame:
    """``df`` with the expression's value: compiled where possible, else the interpreter's array<string> over JSON."""
    try:
        return df.withColumn(output, compile_expression(expression, df[resource], df.schema[resource].dataType).column)
    except NotCompilable:
        from sparkclin.fhirpath.interpreter import evaluate_column

        text = df.withColumn("__json", F.to_json(resource))
        return evaluate_column(text, "__json", expression, output, on_error).drop("__json")
