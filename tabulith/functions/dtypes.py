"""Type classes, type names, and which columns a profile covers."""

from __future__ import annotations

from pyspark.sql import types as T

NAMES = {
    "ByteType": "Int8",
    "ShortType": "Int16",
    "IntegerType": "Int32",
    "LongType": "Int64",
    "FloatType": "Float32",
    "DoubleType": "Float64",
    "StringType": "String",
    "VarcharType": "String",
    "CharType": "String",
    "BooleanType": "Boolean",
    "DateType": "Date",
    "TimestampType": "Datetime",
    "TimestampNTZType": "Datetime",
    "DecimalType": "Decimal",
    "BinaryType": "Binary",
    "ArrayType": "List",
    "StructType": "Struct",
    "MapType": "Map",
    "NullType": "Null",
}


def name_of(kind: T.DataType) -> str:
    return NAMES.get(type(kind).__name__, kind.simpleString())


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType | T.VarcharType | T.CharType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DatetimeType | T.AnsiIntervalType | T.CalendarIntervalType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.StructType | T.MapType | T.VariantType)


def included(schema: T.StructType, include: str | list[str] | None) -> list[str]:
    """Names of the columns that `include` asks for: None or 'numeric', 'all', 'string', 'temporal', or type names
    (`Float64` or `double`)."""
    fields = schema.fields
    if include is None or include == "numeric":
        return [f.name for f in fields if is_numeric(f.dataType)]
    if include == "all":
        return [f.name for f in fields]
    if include == "string":
        return [f.name for f in fields if is_string(f.dataType)]
    if include == "temporal":
        return [f.name for f in fields if is_temporal(f.dataType)]
    if isinstance(include, list | tuple | set):
        wanted = {str(x) for x in include}
        return [f.name for f in fields if {name_of(f.dataType), f.dataType.simpleString()} & wanted]
    raise ValueError("include must be None, 'numeric', 'all', 'string', 'temporal' or a list of type names")


def numeric_columns(schema: T.StructType, wanted: list[str] | None = None) -> list[str]:
    """Numeric columns, of those wanted only, in the order wanted; others are passed over."""
    own = {f.name for f in schema.fields if is_numeric(f.dataType)}
    return [f.name for f in schema.fields if f.name in own] if wanted is None else [c for c in wanted if c in own]
