"""Registration of the named queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outflow.sources.views import Tables, with_views


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Register a query under a name, with the equivalent SQL where SQL can express it."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(fn, with_views(sql, *views) if sql else None)
        return fn

    return register


def presentable(df: DataFrame) -> DataFrame:
    """Dates and times as text, doubles at six places: the form both engines print alike.

    The rounding is plain arithmetic with the tie moved off the half, so that neither the engines' own rounding
    rules nor the last bits of a sum decide a digit.
    """
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
            c = F.when(F.abs(c) < 1e9, F.floor(c * 1e6 + 0.50001) / 1e6).otherwise(c)
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(field.name))
    return df.select(out)


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: presentable(entry.run(Tables(spark, folder)))

    return {name: bind(entry) for name, entry in REGISTRY.items()}


def as_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def r6(c: str) -> str:
    return f"(floor(({c})::DOUBLE * 1e6 + 0.50001) / 1e6)"


def money(c: str) -> str:
    """Exact sum of two-decimal amounts, whatever the order of addition."""
    return f"coalesce(sum(({c})::DECIMAL(18,2)), 0)::DOUBLE"


def r4(c: str) -> str:
    return f"(round(round(({c})::DOUBLE, 10), 4) + 0.0::DOUBLE)"
