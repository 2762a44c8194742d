"""Registered queries: a Spark job, the shape of its result and, where SQL can say it, an oracle.

A shape lists ``name:kind`` with kinds i (whole number), d (double), m (large total, to the cent),
s (text), b (flag), t (time), y (day). The same shape is applied to both sides, so names, types and number formats agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Job
    sql: str | None


QUERIES: dict[str, Query] = {}


def _parse(shape: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in shape.split()]


def shaped(df: DataFrame, shape: str) -> DataFrame:
    """Select the named columns in plain comparable types."""
    columns = []
    for name, kind in _parse(shape):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif kind == "m":
            c = F.round(c.cast("double"), 2) + F.lit(0.0)
        elif kind == "s":
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "y":
            c = F.date_format(c, "yyyy-MM-dd")
        else:
            raise ValueError(f"unknown kind {kind!r} for {name}")
        columns.append(c.alias(name))
    return df.select(*columns)


def shaped_sql(inner: str, shape: str) -> str:
    """The same selection around an oracle statement (``WITH ... SELECT``)."""
    forms = {
        "i": "CAST({c} AS BIGINT)",
        "d": "ROUND(CAST({c} AS DOUBLE), %d) + 0.0::DOUBLE" % DIGITS,
        "m": "ROUND(CAST({c} AS DOUBLE), 2) + 0.0::DOUBLE",
        "s": "CAST({c} AS VARCHAR)",
        "b": "CAST({c} AS BOOLEAN)",
        "t": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
        "y": "strftime({c}, '%Y-%m-%d')",
    }
    columns = [f'{forms[k].format(c=chr(34) + n + chr(34))} AS "{n}"' for n, k in _parse(shape)]
    return f"SELECT {', '.join(columns)} FROM ({inner}) AS result"


def query(name: str, covers: str, shape: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under ``name``; ``covers`` names the operators it exercises."""

    def register(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(
            name,
            tuple(covers.split()),
            lambda spark, folder: shaped(job(spark, folder), shape),
            None if sql is None else shaped_sql(sql, shape),
        )
        return job

    return register
