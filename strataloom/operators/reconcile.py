"""How the values of several observations of one entity become one value."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.normalize import is_empty


def full(column: Column, kind: T.DataType) -> Column:
    """The value, or null where it is empty; 0 and false are values."""
    return F.when(~is_empty(column, "array" if isinstance(kind, T.ArrayType) else "string" if isinstance(kind, T.StringType) else "other"), column)


def preferred(a: Column, b: Column, kind: T.DataType) -> Column:
    """The first of two values that is not empty."""
    return F.coalesce(full(a, kind), full(b, kind))


def merged_lists(a: Column, b: Column) -> Column:
    """Both lists, each element once, order kept."""
    none = F.array()
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def fold(rows: DataFrame, keys: list[str], order: list[str], values: list[str], newest: bool = True) -> DataFrame:
    """One row a key: each of values from the newest (or oldest) row in which it is not empty.

    One shuffle with partial aggregation, whatever the number of values; a key that most rows share is
    reduced before it moves.
    """
    pick = F.max_by if newest else F.min_by
    place = F.struct(*order)

    def chosen(name: str) -> Column:
        value = full(F.col(name), rows.schema[name].dataType)
        return pick(F.col(name), F.when(value.isNotNull(), place)).alias(name)

    return rows.groupBy(*keys).agg(*(chosen(v) for v in values))


def blank(x: object) -> bool:
    return x is None or (isinstance(x, (list, dict)) and not x) or (isinstance(x, str) and not x.strip())


def deep_merge(a: object, b: object) -> object:
    """Objects merge key by key, lists join with each element where it comes first; of two other values the first that is not empty stays, null where both are. What only one object has stays as it is, empty or not."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: deep_merge(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {**a, **b}}
    if isinstance(a, list) and isinstance(b, list):
        return once(a + b)
    return next((x for x in (a, b) if not blank(x)), None)


def once(items: list) -> list:
    """Each item where it comes first; objects are equal whatever the order of their keys."""
    found: dict[str, object] = {}
    for x in items:
        found.setdefault(json.dumps(x, sort_keys=True), x)
    return list(found.values())


@F.pandas_udf(T.StringType())
def merged_json(a: pd.Series, b: pd.Series) -> pd.Series:
    """Two JSON objects as text, merged with the first preferred; text that is no JSON object counts as none. Where one is none the other is the result, and {} where both are."""

    def parsed(text):
        try:
            found = json.loads(text) if isinstance(text, str) else None
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def merged(x, y):
        return deep_merge(x, y) if x is not None and y is not None else x if y is None else y

    out = (merged(parsed(x), parsed(y)) for x, y in zip(a, b, strict=True))
    return pd.Series([json.dumps({} if m is None else m, sort_keys=True, ensure_ascii=False) for m in out])


def largest_copy(rows: DataFrame, keys: list[str], url: str, size: str) -> DataFrame:
    """One row a key with the url of its largest copy (of equal sizes the smallest url), its size and the number of copies."""
    found = rows.groupBy(*keys).agg(F.max(size).alias(size), F.count("*").alias("copies"), F.min_by(url, F.struct(-F.col(size), F.col(url))).alias(url))
    return found.select(*keys, url, size, "copies")


def keepers(sessions: DataFrame, key: str, id_: str, ranks: Mapping[str, int], fields: list[str], own_first: bool = False) -> DataFrame:
    """Sessions that share a key become the one with the smallest id: with the best status by rank, and each field from the first session that has it; `merged` counts what it stands for.

    own_first: after the kept session itself, fields come from the session of the best status (of equal ones the smallest id) that has them, and only null is missing.
    """
    rank = F.lit(-1)
    for name, value in ranks.items():
        rank = F.when(F.col("status") == name, F.lit(value)).otherwise(rank)
    order, rows = F.col(id_), sessions
    if own_first:
        least = sessions.groupBy(key).agg(F.min(id_).alias("_least"))
        rows = sessions.join(least, key)
        order = F.struct(F.when(F.col(id_) == F.col("_least"), 0).otherwise(1), -rank, F.col(id_))
    there = lambda f: F.col(f).isNotNull() if own_first else full(F.col(f), sessions.schema[f].dataType).isNotNull()
    first = [F.min_by(F.col(f), F.when(there(f), order)).alias(f) for f in fields]
    return rows.groupBy(key).agg(F.min(id_).alias(id_), F.max_by("status", F.struct(rank, F.col("status"))).alias("status"), *first, F.count("*").alias("merged"))
