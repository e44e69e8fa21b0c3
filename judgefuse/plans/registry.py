"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Doubles are rounded to 6 places on both sides of every compared output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str = ""


REGISTRY: dict[str, Query] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round(sql: str, doubles: tuple[str, ...] | list[str], places: int = 6) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {places}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] = (), ops: str = ""):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        REGISTRY[name] = Query(name, build, sql_round(sql, doubles) if sql else None, ops)
        return fn
    return deco
