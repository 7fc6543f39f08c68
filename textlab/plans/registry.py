"""Query registry: each entry is a Spark plan over the given tables plus the
equivalent DuckDB SQL (the oracle), with one declared output spec so both
sides come out with the same column names and comparable types.

Spec letters: ``i`` BIGINT, ``d`` DOUBLE rounded to 6 places, ``s`` VARCHAR.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import oracle_with


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None = None          # body over the fixture views / base tables
    views: tuple = ()               # fixture views the SQL needs as CTEs
    exact: bool = True              # False: rows-only check (non-SQL-expressible)

    def columns(self):
        return [tuple(x.split(":")) for x in self.spec.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return normalize(df, self.columns())

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for n, t in self.columns():
            q = f'"{n}"'
            if t == "i":
                cols.append(f"CAST({q} AS BIGINT) AS {q}")
            elif t == "d":  # -0.0 after rounding is written as 0.0 on both sides
                cols.append(f"CASE WHEN round(CAST({q} AS DOUBLE), 6) = 0 THEN CAST(0.0 AS DOUBLE) "
                            f"ELSE round(CAST({q} AS DOUBLE), 6) END AS {q}")
            else:
                cols.append(f"CAST({q} AS VARCHAR) AS {q}")
        inner = oracle_with(self.views, self.sql)
        return f"SELECT {', '.join(cols)} FROM (\n{inner}\n) q"


def normalize(df: DataFrame, columns) -> DataFrame:
    out = []
    for n, t in columns:
        c = F.col(f"`{n}`")
        if t == "i":
            c = c.cast("bigint")
        elif t == "d":
            r = F.round(c.cast("double"), 6)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        else:
            c = c.cast("string")
        out.append(c.alias(n))
    return df.select(*out)


REGISTRY: dict[str, Query] = {}


def register(name: str, spec: str, sql: str | None = None, views=(), exact: bool = True):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, spec, sql, tuple(views), exact and sql is not None)
        return fn
    return deco
