"""How a query is registered beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.views import VIEWS, Views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def counted(sql: str) -> str:
    """count_if(x) as a filtered count, which is a bigint in every engine."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def oracle_text(sql: str) -> str:
    """``sql`` with the views it may name put before it."""
    sql = counted(sql.strip())
    views = ", ".join(f"{name} AS ({text.format_map(_Plain())})" for name, text in VIEWS.items())
    head = next((h for h in ("WITH RECURSIVE ", "WITH ") if sql.upper().startswith(h)), None)
    return f"{head}{views}, {sql[len(head) :]}" if head else f"WITH {views} {sql}"


class _Plain(dict):
    def __missing__(self, key: str) -> str:
        return key


def settled(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles to nine places, as the SQL has them."""
    kinds = {"tinyint": "long", "smallint": "long", "int": "long"}
    cols = [F.col(f"`{c}`").cast(kinds[t]).alias(c) if t in kinds else (F.round(F.col(f"`{c}`"), 9) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*cols)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Registers a function of the views under ``name``."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: settled(f(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return f

    return register
