"""The registered queries: a Spark plan and, where SQL can say the same, the SQL it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosspanel.plans import sqltext
from crosspanel.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Pick and order the output columns; the same column language as ``sqltext.final``.

    Rounding happens only here, on finished results, so that sums taken in another order compare
    equal; the operators themselves never round.
    """
    out = []
    for column in columns:
        name, _, kind = column.partition(":")
        col = F.col(name)
        if kind and re.fullmatch(r"\d+", kind):
            col = F.nanvl(col.cast("double"), F.lit(None).cast("double"))
            col = F.round(col, int(kind)) + F.lit(0.0)
        elif kind:
            col = col.cast(kind)
        out.append(col.alias(name))
    return df.select(*out)


def register(name: str, columns: str, sql: str | None = None, ctes: str | None = None):
    """Register a plan whose output columns are ``columns`` and, with ``sql``, its check."""
    spec = columns.split()

    def wrap(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return tidy(plan(spark, sf_dir), *spec)

        PLANS[name] = run
        if sql is not None:
            SQL[name] = sqltext.final(sql, *spec, ctes=ctes or "")
        return plan

    return wrap
