"""Quality rules as a short-circuit cascade.

Each rule is a Column that says whether a document fails. On a bounded sample the share that a rule rejects is
measured, and its cost estimated from the characters and words it has to visit; rules are then tried in order of
rejection per cost, and a CASE expression stops at the first that rejects. The verdict does not depend on the
order, only the work does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclin.llm.common import SPACE_CHARS, settled, whole_text

SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    """Maximal runs of anything but white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _with_repeat_words(df: DataFrame, words: str, size: int = 5) -> DataFrame:
    """``df`` with __repeats: words that lie in a window of ``size`` words which occurs twice or more, each counted once.

    Windows are compared by a 64-bit hash chained over their words. Only texts that have equal windows are sorted.
    Each step is a column of its own, so that no lambda evaluates an array anew for every element.
    """
    hashes, keys, pairs = F.col("__hashes"), F.col("__keys"), F.col("__pairs")
    step = df.withColumn("__hashes", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    step = step.withColumn("__keys", F.when(F.size(hashes) >= size, windows))
    with_place = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    step = step.withColumn("__pairs", F.when(F.size(keys) > F.size(F.array_distinct(keys)), with_place))
    equal = lambda x, j: (F.get(pairs, j)["k"] == x["k"])
    twice = F.filter(pairs, lambda x, j: F.coalesce((j > 0) & equal(x, j - 1), F.lit(False)) | F.coalesce(equal(x, j + 1), F.lit(False)))
    step = step.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # each start covers up to the next one, the last one a whole window
    starts = F.col("__starts")
    covers = F.transform(starts, lambda i, j: F.least(F.coalesce(F.get(starts, j + 1) - i, F.lit(size)), F.lit(size)))
    return step.withColumn("__repeats", F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text.

    A null text counts as empty, and all counts are 0 for it. Columns of these names are replaced.
    """
    body = whole_text(text)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    step = df.drop(*names).withColumn("__words", _words(body)).withColumn("__lines", lines)
    step = _with_repeat_words(step, "__words")
    return step.select(
        *df.drop(*names).columns,
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.translate(body, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        settled(F.col("__repeats").cast("bigint")).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``fails``: a boolean Column, true where the rule rejects. ``per_char``, ``per_word``: its work in steps per visited item."""

    name: str
    fails: Column
    per_char: float = 0.0
    per_word: float = 0.0


def base_rule() -> Column:
    """Too few words, or more than 20 % of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    body, words, chars = whole_text(text), F.col("n_words"), F.col("word_chars")
    upper = F.length(F.regexp_replace(body, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
    marked = F.size(F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w.rlike(r"(!!|\.\.\.|\?\?)$")))
    return [
        Rule("symbols", 20 * F.col("n_symbols") > chars),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 3) & (2 * F.col("n_dup_lines") > F.size(F.split(body, "\n"))), per_char=1),
        Rule("word_length", (chars < 2 * words) | (chars > 25 * words)),
        Rule("upper_case", 2 * upper > letters, per_char=12),
        Rule("marks", 10 * marked > 3 * words, per_char=3, per_word=4),
    ]


def order_rules(measured: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """``rules`` by rejection per cost, as found on up to ``sample_rows`` rows (documented bound; verdicts do not depend on it).

    A rule that rejects nothing in the sample goes by its cost, behind those that do.
    """
    # a few numbers of each sampled row; a limit that is collected reads only as many parts as it needs, without a shuffle
    flags = [F.coalesce(r.fails, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    rows = measured.select(F.length(whole_text(text)).alias("chars"), F.col("n_words").alias("words"), *flags).limit(sample_rows).collect()
    n = max(1, len(rows))
    chars, words = sum(r["chars"] for r in rows) / n, sum(r["words"] for r in rows) / n
    rejected = [sum(r[f"r{i}"] for r in rows) for i in range(len(rules))]
    cost = [1 + r.per_char * chars + r.per_word * words for r in rules]
    order = sorted(range(len(rules)), key=lambda i: (-(rejected[i] / n) / cost[i], cost[i]))
    return [rules[i] for i in order]


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = None
    for r in rules:
        fails = F.coalesce(r.fails, F.lit(False))
        out = F.when(fails, F.lit(r.name)) if out is None else out.when(fails, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def judge(df: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """``df`` with the counts of ``measure``, base_failed, kept (boolean) and rejected_by (the rule that spoke first, or null).

    Rows are independent: ties and repeated rows each get the same verdict, an empty table gives an empty one, and
    a null text fails the base rule. No shuffle besides the bounded sample.
    """
    measured = measure(df.drop("base_failed", "kept", "rejected_by"), text)
    rules = default_rules(text) if rules is None else rules
    ordered = [Rule("base", base_rule()), *order_rules(measured, rules, text, sample_rows)]
    return measured.withColumn("rejected_by", first_rejection(ordered)).withColumn("base_failed", base_rule()).withColumn("kept", F.col("rejected_by").isNull())
