"""The register of queries, their parameters and pieces of oracle SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from comanda.sources.adapter import ORACLE_TABLES, Shop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters of the registered queries; nothing depends on the clock.
TODAY = "1998-03-15"
NOW = ("1998-01-01", "1998-03-31")
BEFORE = ("1997-07-01", "1997-12-31")
YEAR = ("1998-01-01", "1998-12-31")


def add(name: str, query: Callable[[Shop], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir, query=query: query(Shop(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = ORACLE_TABLES + sql


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0.0 ELSE round(100.0 * ({part}) / ({whole}), 2) END"


def days_of(period: tuple[str, str]) -> str:
    return f"""days AS (SELECT d.day, coalesce(s.r, 0.0) AS revenue, coalesce(s.n, 0) AS num_orders FROM (SELECT CAST(unnest(generate_series(DATE '{period[0]}', DATE '{period[1]}', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN (SELECT bd AS day, sum(total) AS r, count(*) AS n FROM ok GROUP BY 1) s USING (day))"""


def inside(period: tuple[str, str], day: str = "bd") -> str:
    return f"{day} BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"
