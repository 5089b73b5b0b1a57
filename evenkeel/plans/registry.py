"""Registry of queries: a Spark plan and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixture import Fixture, fixture, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(fixture) -> DataFrame` under `name`."""
    def register(fn: Callable[[Fixture], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(fixture(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql.strip())
        return fn
    return register


def shares_sql(rows: str, stratum: str, fraction: float) -> str:
    """Shares of the strata of `rows` by largest remainders: (stratum, share)."""
    return f"""(SELECT {stratum}, base + (row_number() OVER (ORDER BY rest DESC, {stratum}) <= total - sum(base) OVER ())::BIGINT AS share FROM (
      SELECT *, total * n // whole AS base, total * n % whole AS rest FROM (
        SELECT *, whole - ceil(round({round(1 - fraction, 9)} * whole, 9))::BIGINT AS total FROM (
          SELECT {stratum}, n, (sum(n) OVER ())::BIGINT AS whole FROM (SELECT {stratum}, count(*) AS n FROM {rows} GROUP BY 1)))))"""


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every double column, so that summation order cannot show."""
    from pyspark.sql import functions as F

    return df.select(*[
        F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rnd(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}::DOUBLE, {digits}) AS {n}" for n in names)
