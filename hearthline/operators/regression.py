"""Panel regression with state and year effects."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.stats import pearson
from hearthline.storage import materialize


def two_way_fixed_effects(
    panel: DataFrame, y: str, xs: list[str], unit: str = "state_fips", time: str = "year", is_break: str | None = None
) -> dict[str, float]:
    """Coefficients of ``xs`` with unit and time effects.

    A dummy for each (unit, break year) fits that row exactly, which is the same
    as leaving the row out; so breaks are filtered instead of encoded.  The fit
    sums one Gram matrix of (units + years) size over the rows.
    """
    rows = panel.where(~F.col(is_break)) if is_break else panel
    rows = rows.select(F.col(unit).cast("string").alias("_u"), F.col(time).cast("string").alias("_t"), y, *xs).dropna()
    # The indexers and the fit each read the rows.
    rows = materialize(rows, "regression")
    for column in ("_u", "_t"):
        indexer = StringIndexer(inputCol=column, outputCol=f"{column}_i", stringOrderType="alphabetAsc").fit(rows)
        rows = indexer.transform(rows)
    encoder = OneHotEncoder(inputCols=["_u_i", "_t_i"], outputCols=["_uv", "_tv"]).fit(rows)
    features = VectorAssembler(inputCols=[*xs, "_uv", "_tv"], outputCol="_features").transform(encoder.transform(rows))
    fit = LinearRegression(
        featuresCol="_features", labelCol=y, solver="normal", regParam=0.0, standardization=True
    ).fit(features)
    return {x: float(fit.coefficients[i]) for i, x in enumerate(xs)}


def within_r2(panel: DataFrame, y: str, x1: str, x2: str, unit: str = "state_fips") -> DataFrame:
    """R squared of y on two regressors after removing unit means (all rows)."""
    means = panel.groupBy(unit).agg(*[F.avg(c).alias(f"_m_{c}") for c in (y, x1, x2)])
    demeaned = panel.join(means, unit).select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in (y, x1, x2)])
    r1, r2, r12 = pearson(y, x1), pearson(y, x2), pearson(x1, x2)
    return demeaned.agg(r1.alias("r1"), r2.alias("r2"), r12.alias("r12")).select(
        F.try_divide(
            F.col("r1") * F.col("r1") + F.col("r2") * F.col("r2") - 2 * F.col("r1") * F.col("r2") * F.col("r12"),
            1.0 - F.col("r12") * F.col("r12"),
        ).alias("regression_r_squared")
    )
