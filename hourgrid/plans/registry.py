"""Registry of queries: a Spark plan, its output columns and, where SQL can say the same, the SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.session import SETTINGS
from hourgrid.sources.frames import COMMON_SQL, Frames


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Frames], DataFrame]
    columns: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """``columns`` is "name:kind ..." with kinds i(nteger) f(loat) s(tring) d(ay) t(imestamp) b(oolean)."""

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, columns, sql)
        return build

    return register


def _fields(columns: str) -> list[tuple[str, str, int]]:
    out = []
    for token in columns.split():
        name, kind = token.split(":")
        out.append((name, kind[0], int(kind[1:] or 6)))
    return out


def _spark_column(name: str, kind: str, digits: int) -> Column:
    c = F.col(name)
    if kind == "i":
        c = c.cast("bigint")
    elif kind == "b":
        c = c.cast("int").cast("bigint")
    elif kind == "f":
        c = c.cast("double")
        c = F.round(F.when(~F.isnan(c), c), digits) + F.lit(0.0)
    elif kind == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        c = c.cast("string")
    return c.alias(name)


def _sql_column(name: str, kind: str, digits: int) -> str:
    alias, name = name, f'"{name}"'
    if kind == "i":
        e = f"CAST({name} AS BIGINT)"
    elif kind == "b":
        e = f"CAST(CAST({name} AS INTEGER) AS BIGINT)"
    elif kind == "f":
        d = f"CAST({name} AS DOUBLE)"
        e = f"round(CASE WHEN isnan({d}) THEN NULL ELSE {d} END, {digits}) + 0.0"
    elif kind == "d":
        e = f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
    elif kind == "t":
        e = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    else:
        e = f"CAST({name} AS VARCHAR)"
    return f'{e} AS "{alias}"'


def _needed(sql: str) -> list[str]:
    """Shared table expressions used by a text, in definition order."""
    found: set[str] = set()
    queue = [sql]
    while queue:
        for name in re.findall(r"\bhg_\w+", queue.pop()):
            if name in COMMON_SQL and name not in found:
                found.add(name)
                queue.append(COMMON_SQL[name])
    return [n for n in COMMON_SQL if n in found]


def oracle_text(q: Query) -> str:
    body = q.sql.strip().rstrip(";")
    ctes = [f"{n} AS ({COMMON_SQL[n].strip()})" for n in _needed(body)]
    ctes.append(f"answer AS ({body})")
    cols = ", ".join(_sql_column(*f) for f in _fields(q.columns))
    return f"WITH {', '.join(ctes)} SELECT {cols} FROM answer"


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            if key.startswith("spark.sql."):
                spark.conf.set(key, value)
        return q.build(Frames(spark, sf_dir)).select(*[_spark_column(*f) for f in _fields(q.columns)])

    return run
