"""Registry of queries over the benchmark tables and of the SQL each one is checked against.

A column list fixes how results are shown in both engines, so that they can be compared value by
value: ``name`` as is, ``name:int``, ``name:day``, ``name:time`` (both as text), or ``name:N`` for
a number rounded to N digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_column(spec: str) -> Column:
    name, _, kind = spec.partition(":")
    c = F.col(f"`{name}`")
    if kind == "int":
        c = c.cast("long")
    elif kind == "day":
        c = F.date_format(c.cast("date"), "yyyy-MM-dd")
    elif kind == "time":
        c = F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    elif kind:
        # Adding zero turns -0.0 into 0.0.
        c = F.round(c.cast("double"), int(kind)) + 0.0
    return c.alias(name)


def _sql_column(spec: str) -> str:
    name, _, kind = spec.partition(":")
    q = f'"{name}"'
    if kind == "int":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "day":
        return f"strftime(CAST({q} AS DATE), '%Y-%m-%d') AS {q}"
    if kind == "time":
        return f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {q}"
    if kind:
        return f"round(CAST({q} AS DOUBLE), {kind}) + 0.0 AS {q}"
    return q


def query(name: str, columns: str, sql: str | None = None):
    """Register a function of ``Views`` under ``name`` with the SQL that must give the same rows."""
    specs = columns.split()

    def add(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir)).select(*[_spark_column(s) for s in specs])

        run.__doc__ = fn.__doc__
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            cte, _, body = sql.rpartition("\n--\n")
            shown = ", ".join(_sql_column(s) for s in specs)
            ORACLES[name] = f"{cte}\nSELECT {shown} FROM ({body}) AS result"
        return fn

    return add
