"""Results in the reference's wire format, and the JSON sink.

The reference answers with JSON built from MySQL rows: dates and timestamps
are text, decimals are numbers. :func:`to_wire` applies that representation to
a DataFrame as one final projection (no extra stage): ``date`` →
``yyyy-MM-dd``, ``timestamp`` → ``yyyy-MM-dd HH:mm:ss``, decimal → double,
small integers → bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _wire_col(name: str, dt: T.DataType):
    c = F.col(f"`{name}`")
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if isinstance(dt, (T.DecimalType, T.FloatType)):
        return c.cast("double").alias(name)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("bigint").alias(name)
    return c


def to_wire(df: DataFrame) -> DataFrame:
    return df.select(*[_wire_col(f.name, f.dataType) for f in df.schema.fields])


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON object per row (wire format)."""
    w = to_wire(df)
    return w.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in w.columns])).alias(column))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4 sink: newline-delimited JSON, one file per partition."""
    to_wire(df).write.mode(mode).json(path)
