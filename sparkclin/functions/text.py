"""Text normalisation and matching as Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


def normalize_text(value: str | None) -> str | None:
    """Decomposed, without marks, in lower case, letters and digits only."""
    if value is None:
        return None
    flat = unicodedata.normalize("NFKD", value)
    return "".join(c for c in flat.lower() if c.isalnum() and not unicodedata.combining(c))


@pandas_udf(StringType())
def _normalize(values):
    return values.map(normalize_text)


@pandas_udf(ArrayType(StringType()))
def _normalize_all(arrays):
    return arrays.map(lambda values: None if values is None else [normalize_text(v) for v in values])


#: Accented letters of the Latin languages and their base letters, so that most texts never leave the JVM.
ACCENTED = "áàâäãåāçćčéèêëēíìîïīñńóòôöõōøúùûüūýÿžźżßÁÀÂÄÃÅĀÇĆČÉÈÊËĒÍÌÎÏĪÑŃÓÒÔÖÕŌÚÙÛÜŪÝŸŽŹŻ"
PLAIN = "".join((normalize_text(c) or c) if c not in "øß" else c for c in ACCENTED)


def _simple(column: Column) -> tuple[Column, Column]:
    """A text with the accents of Latin letters taken off, and whether that is all that is to be done besides case."""
    simple = F.translate(column, ACCENTED, PLAIN)
    return F.regexp_replace(F.lower(simple), r"[^a-z0-9øß]", ""), ~simple.rlike(r"[^\x00-\x7Føß]")


def normalize(column: Column) -> Column:
    """``normalize_text`` for a Column: ASCII and Latin letters by built-in functions, other texts by an Arrow UDF."""
    fast, plain = _simple(column)
    return F.when(plain, fast).otherwise(_normalize(F.when(~plain, column)))


def normalize_all(values: Column) -> Column:
    """``normalize`` for the texts of an array; only arrays that hold other than Latin letters leave the JVM."""
    other = F.exists(values, lambda v: ~_simple(v)[1])
    return F.when(F.coalesce(other, F.lit(False)), _normalize_all(F.when(other, values))).otherwise(F.transform(values, lambda v: _simple(v)[0]))


def normalize_native(column: Column) -> Column:
    """The built-in part alone, where no Python can run; letters beyond Latin keep their marks."""
    return F.regexp_replace(F.lower(F.translate(column, ACCENTED, PLAIN)), r"[^\p{L}\p{N}]", "")


def strip_html(column: Column) -> Column:
    """Text of a narrative: tags become blanks, six entities are decoded, white space is folded."""
    text = F.regexp_replace(column, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(column: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def matches_query(column: Column, tree) -> Column:
    """Whether a text matches the tree of a full-text query; a null text does not."""
    found = words(F.coalesce(column, F.lit("")))
    line = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))

    def build(t) -> Column:
        if t[0] in ("and", "or"):
            a, b = build(t[1]), build(t[2])
            return a & b if t[0] == "and" else a | b
        if t[0] == "not":
            return ~build(t[1])
        text = t[1] if t[0] == "word" else " ".join(t[1])
        return F.contains(line, F.lit(f" {text} ")) if text else F.lit(True)

    return build(tree)
