"""The entity read API over DataFrames: get, queries by fields, pages, canonical text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 100
OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(v),
    "not_in": lambda c, v: ~c.isin(v),
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
}


def _field(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ValueError(f"unknown field {name}")
    return F.col(name)


def by_fields(df: DataFrame, *conditions: tuple[str, str, object]) -> DataFrame:
    """Rows that fit all (field, operator, value). A null field fits nothing, a null value neither."""
    terms = []
    for name, op, value in conditions:
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        terms.append(F.lit(False) if value is None else OPERATORS[op](_field(df, name), value))
    return df.where(reduce(lambda a, b: a & b, terms)) if terms else df


def page(df: DataFrame, order_by: str = "id", descending: bool = False, limit: int = LIMIT, offset: int = 0, key: str = "id") -> DataFrame:
    """Nulls come last upwards and first downwards; the key breaks ties, so pages do not overlap."""
    c = _field(df, order_by)
    order = [c.desc_nulls_first() if descending else c.asc_nulls_last()]
    if key != order_by:
        order.append(_field(df, key).asc())
    return df.orderBy(*order).offset(offset).limit(limit)


def get(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    return df.where(_field(df, key) == value).limit(1)


def get_one(df: DataFrame, field: str, value: object, key: str = "id") -> DataFrame:
    """The first row, by key, with this value."""
    return by_fields(df, (field, "eq", value)).orderBy(key).limit(1)


def canonical(df: DataFrame, key: str = "id") -> DataFrame:
    """Columns in alphabetical order, all as text: bytes as hex without prefix, lists and structs as JSON; ordered by key."""

    def text(f) -> Column:
        kind = f.dataType.typeName()
        if kind == "binary":
            c = F.lower(F.hex(f.name))
        elif kind in ("array", "struct", "map", "variant"):
            c = F.to_json(f.name)
        else:
            c = F.col(f.name).cast("string")
        return c.alias(f.name)

    return df.select(*[text(df.schema[c]) for c in sorted(df.columns)]).orderBy(key)
