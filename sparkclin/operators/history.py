"""Versions: current, as-of and history reads, and the writes that append versions.

A version table has resource_type, id, version_id, last_updated, resource and deleted (boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("resource_type", "id")


def _newest(rows: DataFrame) -> DataFrame:
    """The row of the highest version of each resource; each task keeps one row a resource before the shuffle."""
    found = rows.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in KEY]), "version_id").alias("__v"))
    return found.select(*[c if c in KEY else F.col(f"__v.{c}").alias(c) for c in rows.columns])


def _deleted(rows: DataFrame) -> Column:
    return F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(False)


def current(versions: DataFrame) -> DataFrame:
    """The newest version of each resource that is not deleted."""
    return _newest(versions).filter(~_deleted(versions))


def as_of(versions: DataFrame, at: str) -> DataFrame:
    """Resources as they were at a time: the newest version not after it, unless that is a deletion."""
    return _newest(versions.filter(F.col("last_updated") <= F.lit(at).cast("timestamp"))).filter(~_deleted(versions))


def read(versions: DataFrame, kind: str, ident: str, version: int | None = None) -> DataFrame:
    rows = versions.filter((F.col("resource_type") == kind) & (F.col("id") == ident))
    return rows.filter(F.col("version_id") == version) if version is not None else current(rows)


def history(versions: DataFrame, kind: str | None = None, ident: str | None = None, since: str | None = None, at: str | None = None, count: int | None = None) -> DataFrame:
    """Versions of a resource, of a type or of all, newest first."""
    rows = versions
    if kind is not None:
        rows = rows.filter(F.col("resource_type") == kind)
    if ident is not None:
        rows = rows.filter(F.col("id") == ident)
    if since is not None:
        rows = rows.filter(F.col("last_updated") >= F.lit(since).cast("timestamp"))
    if at is not None:
        rows = rows.filter(F.col("last_updated") <= F.lit(at).cast("timestamp"))
    rows = rows.orderBy(F.col("last_updated").desc(), F.col("version_id").desc(), "id")
    return rows.limit(count) if count is not None else rows


def append(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The table with changes (resource_type, id, last_updated, resource, deleted) as new versions, numbered on from the last."""
    last = versions.groupBy(*KEY).agg(F.max("version_id").alias("__last"))
    order = Window.partitionBy(*KEY).orderBy("last_updated")
    new = changes.withColumn("__n", F.row_number().over(order)).join(last, list(KEY), "left")
    new = new.withColumn("version_id", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long"))
    return versions.unionByName(new.select(*versions.columns))


def delete(versions: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """Deletions of the resources in ``keys``; those that are deleted or unknown already get none."""
    gone = current(versions).join(keys.select(*KEY).distinct(), list(KEY), "left_semi")
    return append(versions, gone.withColumn("deleted", F.lit(True)).withColumn("last_updated", at).drop("version_id"))


def hard_delete(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """Without all versions of the resources in ``keys``, or without the versions named if it has version_id."""
    on = [*KEY, "version_id"] if "version_id" in keys.columns else list(KEY)
    return versions.join(keys.select(*on).distinct(), on, "left_anti")


#: Order in which the entries of a batch take effect.
METHOD_ORDER = {"DELETE": 0, "POST": 1, "PUT": 2, "PATCH": 2, "GET": 3}


def order_entries(entries: DataFrame) -> DataFrame:
    """Entries (position, method, …) with ``step``, their turn; answers go by position."""
    rank = F.coalesce(*[F.when(F.col("method") == m, F.lit(k)) for m, k in METHOD_ORDER.items()])
    return entries.withColumn("step", F.row_number().over(Window.partitionBy("bundle").orderBy(rank, "position")))


def rewrite_references(resources: DataFrame, names: DataFrame, column: str = "reference") -> DataFrame:
    """References to temporary names (full_url) replaced by the assigned ones (assigned)."""
    renamed = names.select(F.col("full_url").alias(column), "assigned")
    return resources.join(renamed, column, "left").withColumn(column, F.coalesce("assigned", column)).drop("assigned").select(*resources.columns)


def conditional(matches: DataFrame, requests: DataFrame, key: str = "request") -> DataFrame:
    """What a conditional write does: create for no match, update for one, fail for more."""
    found = matches.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    out = requests.select(key).join(found, key, "left")
    action = F.when(F.col("n").isNull(), "create").when(F.col("n") == 1, "update").otherwise("fail")
    return out.select(key, action.alias("action"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def patch(document: dict, operations: list[dict]) -> dict:
    """A JSON Patch applied to one document."""
    import copy

    doc = {"": copy.deepcopy(document)}

    def walk(path: str):
        keys = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
        at = doc[""]
        for k in keys[:-1]:
            at = at[int(k)] if isinstance(at, list) else at[k]
        return at, keys[-1]

    def get(path: str):
        at, k = walk(path)
        return at[int(k)] if isinstance(at, list) else at[k]

    def add(path: str, value):
        at, k = walk(path)
        if isinstance(at, list):
            at.insert(len(at) if k == "-" else int(k), value)
        else:
            at[k] = value

    def remove(path: str):
        at, k = walk(path)
        return at.pop(int(k)) if isinstance(at, list) else at.pop(k)

    for o in operations:
        op, path = o["op"], o["path"]
        if op == "add":
            add(path, o["value"])
        elif op == "remove":
            remove(path)
        elif op == "replace":
            remove(path)
            add(path, o["value"])
        elif op == "move":
            add(path, remove(o["from"]))
        elif op == "copy":
            add(path, copy.deepcopy(get(o["from"])))
        elif op == "test":
            if get(path) != o["value"]:
                raise ValueError(f"test failed at {path}")
        else:
            raise ValueError(f"unknown operation {op}")
    return doc[""]
