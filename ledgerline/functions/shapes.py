"""Short names for Spark types, so that schemas can be stated before a session exists."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, BOOL, BINARY = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.BinaryType()


def array(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
