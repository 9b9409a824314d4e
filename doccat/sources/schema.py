"""Bringing foreign documents into the catalogue's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.config import CATALOG_SCHEMA, PROPS_TYPE
from doccat.functions.props import merge_props


def align_schema(df: DataFrame, spec: T.StructType = CATALOG_SCHEMA) -> DataFrame:
    """Give ``df`` the columns of ``spec``: missing ones null, others cast, unknown ones into ``props``.

    A value that cannot be cast becomes null, a single value of a multi-valued
    field a list of one.
    """
    wanted = {f.name for f in spec.fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    core = [_fit(F.col(f"`{f.name}`"), have[f.name], f.dataType).alias(f.name) if f.name in have
            else F.lit(None).cast(f.dataType).alias(f.name) for f in spec.fields]
    extras = [c for c in have if c not in wanted and c != "props"]
    bag = F.map_filter(
        F.map_from_arrays(
            F.array(*(F.lit(c) for c in extras)).cast("array<string>"),
            F.array(*(_fit(F.col(f"`{c}`"), have[c], T.ArrayType(T.StringType())) for c in extras)).cast(
                "array<array<string>>"
            ),
        ),
        lambda k, v: v.isNotNull(),
    ) if extras else F.create_map().cast(PROPS_TYPE)
    props = merge_props(bag, F.col("props")) if "props" in have else bag
    return df.select(*core, props.alias("props"))


def _fit(value: Column, given: T.DataType, wanted: T.DataType) -> Column:
    if given == wanted:
        return value
    if isinstance(wanted, T.ArrayType):
        if isinstance(given, T.ArrayType):
            return F.transform(value, lambda v: v.try_cast(wanted.elementType))
        return F.when(value.isNotNull(), F.array(value.try_cast(wanted.elementType)))
    if isinstance(given, T.ArrayType):
        value = F.get(value, 0)
    return value.try_cast(wanted)
