"""Registry of named queries: a Spark plan and, where SQL can say it, its independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.plans.oracle_views import compose

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def oracles() -> dict[str, str]:
    return {name: compose(sql) for name, sql in ORACLES.items()}


def _nudge(digits: int) -> float:
    """Engines round exact halves differently; 1.7 % of a unit moves decimal inputs off the half."""
    return 0.0173 * 10**-digits


def rounded(digits: int, *names: str) -> list[Column]:
    """Columns rounded for comparison; adding 0.0 turns negative zero into zero."""
    return [(F.round(F.col(n) + F.lit(_nudge(digits)), digits) + F.lit(0.0)).alias(n) for n in names]


def sql_round(digits: int, expression: str) -> str:
    return f"round(({expression}) + {_nudge(digits):e}, {digits}) + 0e0"


def sql_rounded(digits: int, *names: str) -> str:
    return ", ".join(f"{sql_round(digits, n)} AS {n}" for n in names)
