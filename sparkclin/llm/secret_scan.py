"""Secret scans: three fixed patterns, and runs of characters of high entropy.

Candidate strings are long runs over one character class (hexadecimal digits, the base64 alphabet, letters of one case
with digits). A window
slides over each candidate; one character comes in and one goes out, so the counts and the sum of c*log2(c), and
with them the Shannon entropy of the window, are updated instead of computed anew. A candidate whose highest
window reaches its class's threshold is a finding unless an allow-list pattern (placeholders, UUIDs, paths,
plain words) suppresses it or a pattern has already found it.

Everything is a SQL function of the row's own text: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.llm.common import settled, whole_text

# The patterns whose findings are always kept; the last number is the length they need.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more in all
HEX = r"[0-9a-f]{16,}"

#: Windows that start in one block of a candidate.
BLOCK = 96

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_alnum")


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters with the window and the entropy, in bits, from which a run over it is a finding."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    #: What a candidate must hold besides.
    needs: str


_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: What no part of a path holds: a plus, a letter just after a digit, a long number, a letter alone.
_NO_PATH = r"\+|[0-9][A-Za-z]|[0-9]{11}|(?<![A-Za-z])[a-z](?![a-z0-9])|(?<![A-Z])[A-Z](?![A-Za-z0-9])"
#: Words and numbers with signs between them.
_SLUG = r"[_-]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)(?:[_-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+))*[_-]*"

CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-F]{24,}", "0123456789ABCDEF", 24, 3.0, r"[0-9].*[A-F]|[A-F].*[0-9]"),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", _BASE64, 24, 3.8, r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"),
    CharacterClass("entropy_alnum", r"[a-z0-9_-]{24,}|[A-Z0-9_-]{24,}", _BASE64, 24, 3.5, rf"^(?=.*[0-9])(?=.*[A-Za-z])(?!{_SLUG}$)"),
)

#: Findings of the entropy scan that are no secrets.
ALLOWED = (
    r"(?i)example|placeholder|redacted|changeme|your[_-]?(key|token|secret)",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    rf"^(?=/|[^/]*/[^/]*/[^/]*/)(?!.*(?:{_NO_PATH}))",
    r"^[A-Za-z]+([_-][A-Za-z]+)*[_-]?[0-9]{1,4}$",
    r"^(.)\1+$",
)


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _with_running(df: DataFrame, name: str, values: str, combine) -> DataFrame:
    """``df`` with the column ``name``: for each element of the array ``values`` what those before it combine to, from 0.

    An array grows by being copied, so it is taken in portions of the square root of its size: each portion is combined
    whole, the portions one after another, and then the elements of each portion from there.
    """

    def run(part: Column, first: Column) -> Column:
        start = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    zero, n = F.lit(0).cast("bigint"), F.size(values)
    width = F.ceil(F.sqrt(n)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: F.slice(values, k * width + 1, width))
    # each step is a column of its own that is not folded into the next, as a lambda would evaluate it for every element
    step = df.withColumn("__cut", settled(F.when(n > 0, cut)))
    step = step.withColumn("__from", settled(run(F.transform("__cut", lambda part: F.aggregate(part, zero, combine)), zero)))
    out = F.flatten(F.transform(F.arrays_zip("__cut", "__from"), lambda x: run(x["__cut"], x["__from"])))
    return step.withColumn(name, settled(F.coalesce(out, F.array().cast("array<bigint>")))).drop("__cut", "__from")


def _with_spans(df: DataFrame, text: Column, patterns: list[tuple]) -> DataFrame:
    """``df`` with __spans: the matches of all patterns that pass their test, by pattern and start.

    Places in code points come from the lengths of the matches and of the texts between them. Those of one pattern add
    up to the whole text, so one running sum, modulo its length, serves all of them.
    """
    none = F.array().cast("array<struct<kind:int,gap:int,m:string>>")
    step = df.withColumns({f"__m{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p, _ in patterns})

    def parts(k: int, p: str) -> Column:
        pairs = F.arrays_zip(F.split(text, p, -1).alias("g"), F.col(f"__m{k}").alias("m"))
        made = F.transform(pairs, lambda x: F.struct(F.lit(k).alias("kind"), F.length(x["g"]).alias("gap"), x["m"].alias("m")))
        return F.when(F.size(f"__m{k}") > 0, made).otherwise(none)

    step = step.withColumn("__parts", settled(F.concat(*[parts(k, p) for k, p, _ in patterns])))
    step = step.withColumn("__ahead", settled(F.transform("__parts", lambda x: (x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))).cast("bigint"))))
    step = _with_running(step, "__at", "__ahead", lambda a, b: a + b)

    def passes(x: Column) -> Column:
        out = F.lit(False)
        for k, _, keep in patterns:
            out = F.when(x["kind"] == k, keep(x["m"])).otherwise(out)
        return x["m"].isNotNull() & out

    found = F.filter(F.arrays_zip(F.col("__parts").alias("p"), F.col("__at").alias("at"), F.array_repeat(F.length(text), F.size("__parts")).alias("n")), lambda x: passes(x["p"]))

    def span(x: Column) -> Column:
        start = x["at"] % x["n"] + x["p"]["gap"]
        return F.struct(start.cast("bigint").alias("start"), x["p"]["kind"].alias("kind"), (start + F.length(x["p"]["m"])).cast("bigint").alias("end"))

    return step.withColumn("__spans", settled(F.when(F.size("__parts") > 0, F.transform(found, span)).otherwise(F.array().cast(SPANS))))


def _with_apart(df: DataFrame, taken: str, kind: int) -> DataFrame:
    """``df`` whose spans in the array ``taken`` have been joined by those of ``kind`` that overlap none of them.

    Sorted by start, a span overlaps another one if one before it ends behind its start, or the next one starts before its
    end; spans of one kind do not overlap each other.
    """
    flagged = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("taken"), s["kind"].alias("kind"), s["end"].alias("end")))
    own = F.filter("__spans", lambda s: s["kind"] == kind)
    step = df.withColumn("__own", settled(own))
    both = F.sort_array(F.concat(flagged(F.col(taken), 1), flagged(F.col("__own"), 0)))
    step = step.withColumn("__both", settled(F.when(F.size("__own") > 0, both)))
    step = step.withColumn("__ends", settled(F.when(F.size("__own") > 0, F.transform("__both", lambda s: F.when(s["taken"] == 1, s["end"]).otherwise(0)))))
    step = _with_running(step, "__reach", "__ends", lambda a, b: F.greatest(a, b))
    after = F.slice("__both", 2, F.greatest(F.size("__both"), F.lit(1)))
    rows = F.arrays_zip(F.col("__both").alias("s"), F.col("__reach").alias("reach"), after.alias("next"))
    free = lambda x: (x["s"]["taken"] == 0) & (x["reach"] <= x["s"]["start"]) & ~F.coalesce((x["next"]["taken"] == 1) & (x["next"]["start"] < x["s"]["end"]), F.lit(False))
    added = F.transform(F.filter(rows, free), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))
    return step.withColumn(taken, settled(F.when(F.size("__own") > 0, F.concat(F.col(taken), added)).otherwise(F.col(taken))))


def window_entropy(value: Column, cls: CharacterClass) -> Column:
    """The highest Shannon entropy of any window of the value, by incremental counts; null where it is shorter.

    As the window moves, only the counts of the character that leaves and of the one that enters change. The value is
    taken in blocks that overlap by a window, so that each step looks at short texts only.
    """
    w, f = cls.window, F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(cls.window + 1)])
    blocks = F.regexp_extract_all(value, F.lit(rf"(?=(.{{1,{BLOCK + w - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    times = lambda inside, c: F.length(inside) - F.length(F.replace(inside, c, F.lit("")))

    def best(block: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            leaves = i > w
            c = F.substring(block, i, F.lit(1))
            old, out = times(acc["window"], F.substring(acc["window"], 1, 1)), F.when(leaves, F.substring(acc["window"], 2, w)).otherwise(acc["window"])
            new = times(out, c)
            s = acc["s"] + F.when(leaves, F.get(f, old - 1) - F.get(f, old)).otherwise(F.lit(0.0)) + F.get(f, new + 1) - F.get(f, new)
            bits = F.lit(math.log2(w)) - s / w
            return F.struct(F.concat(out, c).alias("window"), s.alias("s"), F.when(i >= w, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

        zero = F.struct(F.lit("").alias("window"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.length(block)), zero, step, lambda acc: acc["best"])

    return F.when(F.length(value) >= w, F.array_max(F.transform(blocks, best)))


def _allowed(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | value.rlike(pattern)
    return out


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``: array<struct<start, kind, end, name>> of its findings by start, then kind as in KINDS.

    Places are code points, ends are exclusive. A null or empty text has none. Rows are independent: repeated rows
    get equal findings, an empty table gives an empty one; a column named secrets is replaced.
    """
    names = df.drop("secrets").columns
    patterns = [(0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE), (1, ACCESS, lambda m: F.lit(True)), (2, HEX, lambda m: F.lit(True))]
    patterns += [(KINDS.index(c.kind), c.pattern, lambda m, c=c: m.rlike(c.needs) & ~_allowed(m) & (window_entropy(m, c) >= c.bits)) for c in CLASSES]
    step = _with_spans(df.drop("secrets"), whole_text(text), patterns)
    step = step.withColumn("__taken", settled(F.filter("__spans", lambda s: s["kind"] < 3)))
    for c in CLASSES:
        step = _with_apart(step, "__taken", KINDS.index(c.kind))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.sort_array("__taken"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(kinds, s["kind"]).alias("name")))
    return step.select(*names, settled(named).alias("secrets"))


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter(F.col("secrets"), lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def base_spans() -> Column:
    """The findings of the three patterns."""
    return F.filter(F.col("secrets"), lambda s: s["kind"] < 3)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every finding in its text replaced by ``mark``; texts without one, null ones too, stay as they are.

    Overlapping findings, those that tie in their start too, are replaced as one. Rows are independent, repeated rows become
    equal texts, an empty table gives an empty one. All columns stay but for those named secrets, which is left out.
    """
    names = [c for c in df.columns if c != "secrets"]
    step = find_secrets(df, text)
    step = step.withColumn("__ends", settled(F.transform("secrets", lambda s: s["end"])))
    step = _with_running(step, "__reach", "__ends", lambda a, b: F.greatest(a, b))
    # the texts between the findings, from the end of what came before to the start of the next
    rows = F.filter(F.arrays_zip(F.col("secrets").alias("s"), F.col("__reach").alias("reach")), lambda x: x["s"]["start"] >= x["reach"])
    step = step.withColumn("__gaps", settled(F.transform(rows, lambda x: F.struct(x["reach"].cast("int").alias("lo"), x["s"]["start"].cast("int").alias("hi")))))
    # cut out in two steps, as each cut walks through the text it is made in
    n = F.size("__gaps")
    width = F.ceil(F.sqrt(n)).cast("int")
    step = step.withColumn("__lots", settled(F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: F.slice("__gaps", k * width + 1, width)))))
    lot = lambda g: F.struct(g.alias("gaps"), F.get(g, 0)["lo"].alias("lo"), F.substring(F.col(text), F.get(g, 0)["lo"] + 1, F.element_at(g, -1)["hi"] - F.get(g, 0)["lo"]).alias("t"))
    step = step.withColumn("__lots", settled(F.transform("__lots", lot)))
    cut = F.transform("__lots", lambda x: F.array_join(F.transform(x["gaps"], lambda g: F.concat(F.substring(x["t"], g["lo"] - x["lo"] + 1, g["hi"] - g["lo"]), F.lit(mark))), ""))
    tail = F.substring(F.col(text), (F.array_max("__ends") + 1).cast("int"), F.length(text))
    return step.withColumn(text, F.when(F.size("__gaps") > 0, F.concat(F.array_join(cut, ""), tail)).otherwise(F.col(text))).select(*names)
