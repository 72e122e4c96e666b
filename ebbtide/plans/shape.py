"""Output shaping shared by the registered queries: portable types and rounded doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.plans.base import r6


def rounded(c: Column, digits: int = 6) -> Column:
    """Round by way of nine digits, so that halves come out alike in both engines."""
    return F.round(F.round(c.cast("double"), 9), digits)


def portable(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Integers as bigint, doubles rounded, dates and timestamps as text."""
    out = []
    for name in cols or df.columns:
        kind = df.schema[name].dataType
        c = F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = rounded(c, digits)
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(name))
    return df.select(*out)


def sql_cols(spec: str, digits: int = 6) -> str:
    """Select list from ``kind:name`` words; kinds: s text, i integer, d double, t date, m moment."""
    out = []
    for word in spec.split():
        kind, name = word.split(":")
        quoted = f'"{name}"' if name != name.lower() else name
        expr = {
            "s": quoted,
            "i": f"{quoted}::BIGINT",
            "d": r6(quoted, digits),
            "t": f"strftime({quoted}, '%Y-%m-%d')",
            "m": f"strftime({quoted}, '%Y-%m-%d %H:%M:%S')",
        }[kind]
        out.append(f"{expr} AS {quoted}")
    return ", ".join(out)


def names(spec: str) -> list[str]:
    return [word.split(":")[1] for word in spec.split()]
