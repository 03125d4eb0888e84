"""Kinds of values, and the types of both dialects in Spark's.

A kind is what lowering needs to know of a type: int, double, decimal, str, bool, date, time, timestamp,
binary, array, struct, interval, null, or ``?`` where it isn't known.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tandemql.sql.dialect import SqlError

NUMERIC = {"int", "double", "decimal"}
TEMPORAL = {"date", "timestamp", "time"}

_KINDS = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
    ((T.FloatType, T.DoubleType), "double"),
    ((T.DecimalType,), "decimal"),
    ((T.StringType, T.VarcharType, T.CharType), "str"),
    ((T.BooleanType,), "bool"),
    ((T.DateType,), "date"),
    ((T.TimestampType, T.TimestampNTZType), "timestamp"),
    ((T.BinaryType,), "binary"),
    ((T.ArrayType,), "array"),
    ((T.StructType,), "struct"),
    ((T.NullType,), "null"),
]


def kind_of(data_type: T.DataType) -> str:
    for classes, kind in _KINDS:
        if isinstance(data_type, classes):
            return kind
    return "time" if data_type.simpleString().startswith("time") else "?"


# SQL type names (without arguments) to (Spark type, kind).
_NAMES = {
    "BOOLEAN": ("BOOLEAN", "bool"), "BOOL": ("BOOLEAN", "bool"),
    "TINYINT": ("BIGINT", "int"), "SMALLINT": ("BIGINT", "int"), "MEDIUMINT": ("BIGINT", "int"), "INT": ("BIGINT", "int"), "INTEGER": ("BIGINT", "int"),
    "BIGINT": ("BIGINT", "int"), "SIGNED": ("BIGINT", "int"), "SIGNED INTEGER": ("BIGINT", "int"), "INT2": ("BIGINT", "int"), "INT4": ("BIGINT", "int"), "INT8": ("BIGINT", "int"), "SERIAL": ("BIGINT", "int"), "YEAR": ("BIGINT", "int"),
    "UNSIGNED": ("DECIMAL(20,0)", "decimal"), "UNSIGNED INTEGER": ("DECIMAL(20,0)", "decimal"), "BIGINT UNSIGNED": ("DECIMAL(20,0)", "decimal"), "INT UNSIGNED": ("BIGINT", "int"),
    "FLOAT": ("DOUBLE", "double"), "REAL": ("DOUBLE", "double"), "DOUBLE": ("DOUBLE", "double"), "DOUBLE PRECISION": ("DOUBLE", "double"), "FLOAT4": ("DOUBLE", "double"), "FLOAT8": ("DOUBLE", "double"),
    "CHAR": ("STRING", "str"), "VARCHAR": ("STRING", "str"), "NCHAR": ("STRING", "str"), "CHARACTER": ("STRING", "str"), "CHARACTER VARYING": ("STRING", "str"), "TEXT": ("STRING", "str"), "MEDIUMTEXT": ("STRING", "str"), "LONGTEXT": ("STRING", "str"),
    "JSON": ("STRING", "str"), "JSONB": ("STRING", "str"), "ENUM": ("STRING", "str"), "UUID": ("STRING", "str"),
    "BINARY": ("BINARY", "binary"), "VARBINARY": ("BINARY", "binary"), "BLOB": ("BINARY", "binary"), "BYTEA": ("BINARY", "binary"),
    "DATE": ("DATE", "date"), "TIME": ("TIME", "time"), "DATETIME": ("TIMESTAMP_NTZ", "timestamp"), "TIMESTAMP": ("TIMESTAMP_NTZ", "timestamp"),
    "TIMESTAMPTZ": ("TIMESTAMP", "timestamp"), "TIMESTAMP WITH TIME ZONE": ("TIMESTAMP", "timestamp"), "TIMESTAMP WITHOUT TIME ZONE": ("TIMESTAMP_NTZ", "timestamp"),
}


def spark_type(name: str) -> tuple[str, str]:
    """A type of either dialect, as (Spark type, kind)."""
    text = name.upper()
    if text.endswith("[]"):
        return f"ARRAY<{spark_type(text[:-2])[0]}>", "array"
    plain = re.sub(r"\([^)]*\)", "", text).strip()
    if plain in ("DECIMAL", "NUMERIC", "DEC"):
        args = re.search(r"\(([^)]*)\)", text)
        return f"DECIMAL({args[1] if args else '10,0'})" if args or plain != "NUMERIC" else "DECIMAL(38,10)", "decimal"
    if plain not in _NAMES:
        raise SqlError(f"unknown type {name}")
    return _NAMES[plain]
