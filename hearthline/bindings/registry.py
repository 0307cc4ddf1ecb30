"""Registration of queries."""

from __future__ import annotations

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` function under ``name``."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = (function, sql)
        return function

    return register


def _columns(spec: str) -> list[tuple[str, int]]:
    """``"a b:2"`` -> ``[("a", 6), ("b", 2)]``: columns and decimals to compare at."""
    parts = [p.partition(":") for p in spec.split()]
    return [(name, int(digits or 6)) for name, _, digits in parts]


def rounded(df, spec: str):
    """Round double columns for comparison; adding zero turns -0.0 into 0.0."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, digits in _columns(spec)})


def rounded_sql(body: str, spec: str) -> str:
    """The same rounding around a SQL body."""
    changes = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c, digits in _columns(spec))
    return f"\nSELECT * REPLACE ({changes}) FROM ({body})"


def pvalue_sql(r: str, n: str) -> str:
    """Two-sided p-value of a correlation in SQL: the same share of a t distribution, its terms by gamma functions."""
    odd, v, x = f"(({n} - 2) % 2)", f"({n} - 2)", f"least(1.0, abs({r}))"
    even = f"lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi())"
    other = f"lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)"
    term = f"exp(CASE WHEN {odd} = 1 THEN {other} ELSE {even} END + k * ln(1 - {x} * {x}))"
    total = f"coalesce(list_sum(list_transform(range(0, CAST(({v} - 2 - {odd}) // 2 + 1 AS BIGINT)), lambda k: {term})), 0.0)"
    share = f"CASE WHEN {odd} = 1 THEN (asin({x}) + {x} * sqrt(1 - {x} * {x}) * {total}) * 2 / pi() ELSE {x} * {total} END"
    return f"CASE WHEN {n} < 3 OR {r} IS NULL THEN NULL WHEN {x} >= 1 THEN 0.0 ELSE greatest(0.0, 1 - ({share})) END"
