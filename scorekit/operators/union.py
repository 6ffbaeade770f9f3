"""Union of sources by column name, with lossless common types, and its profile as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.errors import DuplicateColumnError
from scorekit.functions.constants import ORDER_COL
from scorekit.functions.rules import sensitive_name
from scorekit.functions.text import key_text, or_null
from scorekit.operators._cols import q

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)  # from narrow to wide
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_FRACTIONAL = (T.FloatType, T.DoubleType)
_MAX_DIGITS = 38
# Whole numbers that a floating type holds without loss.
_FITS = {T.FloatType: (T.ByteType, T.ShortType), T.DoubleType: (T.ByteType, T.ShortType, T.IntegerType)}


def column_universe(dfs: list[DataFrame]) -> list[str]:
    """Distinct column names over all sources, in order of first appearance."""
    seen: dict[str, None] = {}
    for df in dfs:
        for c in df.columns:
            seen.setdefault(c, None)
    return list(seen)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds every value of both without loss; text if there is none.

    Whole numbers widen; decimals keep all digits on both sides of the point (also of whole numbers);
    whole numbers of up to 32 bits fit a double, ``bigint`` does not; float widens to double; a date
    is a timestamp at midnight; structs, arrays and maps are reconciled part by part.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, _FRACTIONAL) and isinstance(b, _FRACTIONAL):
        return T.DoubleType()
    for x, y in ((a, b), (b, a)):
        if isinstance(x, _WHOLE) and isinstance(y, _FRACTIONAL):
            if isinstance(x, _FITS[type(y)]):
                return y
            return T.DoubleType() if isinstance(x, _FITS[T.DoubleType]) else T.StringType()
        if isinstance(x, T.DateType) and isinstance(y, (T.TimestampType, T.TimestampNTZType)):
            return y
    decimals = [_as_decimal(t) for t in (a, b)]
    if all(decimals):
        scale = max(s for _, s in decimals)
        digits = max(p - s for p, s in decimals) + scale
        return T.DecimalType(digits, scale) if digits <= _MAX_DIGITS else T.StringType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b.fields}
        fields = [T.StructField(f.name, common_type(f.dataType, other.pop(f.name, T.NullType()))) for f in a.fields]
        return T.StructType([*fields, *(T.StructField(n, t) for n, t in other.items())])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, common_type(a.valueType, b.valueType))
    return T.StringType()


def _as_decimal(t: T.DataType) -> tuple[int, int] | None:
    if isinstance(t, T.DecimalType):
        return t.precision, t.scale
    return (_DIGITS[type(t)], 0) if isinstance(t, _WHOLE) else None


def as_type(c: Column, own: T.DataType, wanted: T.DataType) -> Column:
    """A cell of type ``own`` as the common type ``wanted``. As text, whole numbers of any type
    print without a fraction (as keys do) and nested values as JSON."""
    if own == wanted:
        return c
    if isinstance(wanted, T.StringType):
        return F.to_json(c) if isinstance(own, (T.StructType, T.ArrayType, T.MapType)) else key_text(c, own)
    if isinstance(wanted, T.StructType) and isinstance(own, T.StructType):
        have = {f.name: f.dataType for f in own.fields}
        parts = [(as_type(c.getField(f.name), have[f.name], f.dataType) if f.name in have
                  else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(wanted, T.ArrayType) and isinstance(own, T.ArrayType):
        return F.transform(c, lambda e: as_type(e, own.elementType, wanted.elementType))
    if isinstance(wanted, T.MapType) and isinstance(own, T.MapType):
        return F.transform_values(c, lambda _, v: as_type(v, own.valueType, wanted.valueType))
    return c.cast(wanted)


def common_types(dfs: list[DataFrame]) -> dict[str, T.DataType]:
    """Name and common type of every column of the sources, in order of first appearance."""
    types: dict[str, T.DataType] = {}
    for df in dfs:
        for f in df.schema.fields:
            types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else f.dataType
    return types


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a source is null there, and so is a nested field.

    Column order is order of first appearance. A name whose types differ gets their common type in
    every source *before* the union (:func:`common_type`), so no cell loses digits: ``1`` and ``'E7'``
    in one column both survive, and so do ``9007199254740993`` and ``1.5``, as text. Names differing
    only by case are distinct columns; with ``spark.sql.caseSensitive=false`` they cannot be, and
    ``DuplicateColumnError`` is raised.
    """
    if not dfs:
        raise ValueError("union_sources needs at least one DataFrame")
    spark = dfs[0].sparkSession
    wanted = common_types(dfs)
    case_sensitive = spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    if not case_sensitive:
        lowered: dict[str, str] = {}
        for c in wanted:
            other = lowered.setdefault(c.lower(), c)
            if other != c:
                raise DuplicateColumnError(
                    f"columns {other!r} and {c!r} differ only by case; "
                    "set spark.sql.caseSensitive=true to keep both")
    fixed = [df.select(*[as_type(q(f.name), f.dataType, wanted[f.name]).alias(f.name) for f in df.schema.fields])
             if any(f.dataType != wanted[f.name] for f in df.schema.fields) else df for df in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fixed)


def schema_profile(dfs: list[DataFrame]) -> DataFrame:
    """What the union of the sources will look like, one row per column of any of them.

    ``name``, ``position`` (of first appearance, from 0), ``sources`` (numbers of those that have it),
    ``types`` (there, in the same order), ``present`` (cells that are not missing, over all sources),
    ``common_type`` (what :func:`union_sources` makes of it) and ``sensitive`` (the name looks like
    personal data). One aggregation pass per source; the rest is metadata.
    """
    if not dfs:
        raise ValueError("schema_profile needs at least one DataFrame")
    wanted = common_types(dfs)
    wanted.pop(ORDER_COL, None)
    place = {name: i for i, name in enumerate(wanted)}
    counted = []
    for number, df in enumerate(dfs):
        fields = [f for f in df.schema.fields if f.name in place]
        cells = [F.struct(F.lit(f.name).alias("name"), F.lit(place[f.name]).alias("position"), F.lit(number).alias("source"),
                          F.lit(f.dataType.simpleString()).alias("type"),
                          F.lit(wanted[f.name].simpleString()).alias("common_type"),
                          F.count(or_null(q(f.name), f.dataType)).alias("present")) for f in fields]
        if cells:
            counted.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    by_source = F.sort_array(F.collect_list(F.struct("source", "type")))  # one entry per source that has the column
    return (reduce(DataFrame.unionByName, counted).groupBy("name", "position", "common_type")
            .agg(by_source.alias("own"), F.sum("present").alias("present"))
            .select("name", "position", F.col("own.source").alias("sources"), F.col("own.type").alias("types"),
                    "present", "common_type", sensitive_name(F.col("name")).alias("sensitive")))
