"""Unions, differences and duplicate checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

# Types of columns that may arrive without one.
KNOWN_TYPES = {"audios": "array<string>", "audio_durations": "array<double>", "audio_tokens": "array<bigint>", "num_tokens_est": "bigint"}


def typed(rows: DataFrame, others: list[DataFrame] | None = None) -> DataFrame:
    """Columns of no type get their known type, the type another table has, or string."""
    out = rows
    for f in rows.schema.fields:
        if isinstance(f.dataType, NullType):
            found = next((o.schema[f.name].dataType for o in others or [] if f.name in o.columns and not isinstance(o.schema[f.name].dataType, NullType)), None)
            out = out.withColumn(f.name, F.col(f"`{f.name}`").cast(found or KNOWN_TYPES.get(f.name, "string")))
    return out


def aligned_union(tables: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns become null and the leftmost table that types a column decides its type."""
    if not tables:
        raise ValueError("nothing to unite")
    ready = [typed(t, tables) for t in tables]
    types = {}
    for t in ready:
        for f in t.schema.fields:
            types.setdefault(f.name, f.dataType)
    cast = [t.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) for c in t.columns]) for t in ready]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def tagged_union(tables: dict[str, DataFrame], tag: str = "source_name") -> DataFrame:
    return aligned_union([t.withColumn(tag, F.lit(name)) for name, t in tables.items()])


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, or an error that names a repeated key."""
    found = duplicates(rows, *keys).head(1)
    if found:
        raise ValueError(f"repeated key {tuple(found[0])[:-1]}")
    return rows


def difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")
