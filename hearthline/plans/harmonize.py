"""Merging component tables into one county-year panel and filling its gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import columns as C
from hearthline.operators import spatial, windows
from hearthline.operators.clean import dedup_first
from hearthline.operators.joins import stack_outer
from hearthline.storage import materialize


def merge_components(tables: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge of the component tables present, with namespaced extras."""
    parts = []
    for source in dict.fromkeys(s for s, _, _ in P.COMPONENT_SOURCES.values()):
        if source not in tables:
            continue
        table, renames, extras = tables[source], {}, {}
        for component, (origin, value, auxiliary) in P.COMPONENT_SOURCES.items():
            if origin != source or value not in table.columns:
                continue
            # One source column may feed a component and an extra of another.
            extras[component] = F.col(value)
            extras.update({f"{component}__{a}": F.col(a) for a in auxiliary if a in table.columns})
        if not extras:
            continue
        renames = {name: name for name in extras}
        once = dedup_first(
            table.select("fips", F.col("year").cast("int").alias("year"), *[c.alias(n) for n, c in extras.items()]),
            ["fips", "year"],
            [],
        )
        parts.append((once, renames))
    if not parts:
        raise ValueError("no component table given")
    return stack_outer(parts, ["fips", "year"])


def add_provenance(panel: DataFrame) -> DataFrame:
    """Confidence and attribution of each component present, and the component count."""
    registry = {c.id: c for c in P.REGISTRY}
    present = [c for c in P.COMPONENT_IDS if c in panel.columns]
    labels = {}
    for c in present:
        labels[f"{c}__confidence"] = F.lit(registry[c].confidence)
        labels[f"{c}__attribution"] = F.lit(registry[c].attribution)
    return panel.withColumns({**labels, "component_count": C.present_count(present)})


def gap_candidates(panel: DataFrame, components: list[str]) -> DataFrame:
    """Long ``(fips, year, component, value)`` of component-years worth filling.

    A component-year qualifies with values for a tenth of the counties or more
    and at least one gap.
    """
    long = panel.unpivot(["fips", "year"], components, "component", "value")
    counts = long.groupBy("year", "component").agg(
        F.count("value").alias("_valid"), F.count(F.lit(1)).alias("_all")
    )
    worth = counts.where(
        (F.col("_valid") >= F.col("_all") * P.IDW_MIN_COVERAGE) & (F.col("_valid") < F.col("_all"))
    )
    return long.join(worth.select("year", "component"), ["year", "component"], "left_semi")


def idw_gap_fill(
    panel: DataFrame, centroids: DataFrame, components: list[str] | None = None,
    k: int = P.IDW_NEIGHBOURS, power: float = P.IDW_POWER, max_km: dict[str, float] | None = None,
) -> DataFrame:
    """Gaps of the measured components filled from near counties of the same year."""
    names = [c for c in (components or P.IDW_COMPONENTS) if c in panel.columns]
    # Coverage, gaps and the filled result all read the panel.
    panel = materialize(panel, "gapped")
    limits = max_km or P.IDW_MAX_KM
    reach = P.lookup({c: float(limits.get(c, P.IDW_MAX_KM_DEFAULT)) for c in names}, F.col("component"))
    places = dedup_first(centroids.select("fips", "lat", "lon"), ["fips"], ["lat", "lon"])
    # Read as queries and, several times, as sources.
    located = materialize(
        gap_candidates(panel, names).join(places, "fips").withColumn("max_km", reach), "located"
    )
    keys = ["year", "component"]
    neighbours = spatial.nearest_neighbours(
        located.where(F.col("value").isNull()).drop("value"), located.where(F.col("value").isNotNull()), keys, "fips", k
    )
    estimates = spatial.idw_estimates(neighbours, keys, "fips", power)
    wide = estimates.groupBy("fips", "year").pivot("component", names).agg(
        F.first("estimate").alias("est"), F.first("nearest_km").alias("km")
    )
    joined = panel.join(wide, ["fips", "year"], "left")
    filled = {}
    for c in names:
        filled[c] = F.coalesce(F.col(c).cast("double"), F.col(f"{c}_est"))
        filled[f"{c}__gap_filled"] = F.col(c).isNull() & F.col(f"{c}_est").isNotNull()
        filled[f"{c}__nearest_monitor_km"] = F.when(F.col(c).isNull(), F.col(f"{c}_km"))
    return joined.withColumns(filled).drop(*[f"{c}_{x}" for c in names for x in ("est", "km")])


def downgrade_by_distance(panel: DataFrame, components: list[str] | None = None) -> DataFrame:
    """Lower the confidence of filled values: one step, two for far air monitors."""
    changed = {}
    for c in components or P.IDW_COMPONENTS:
        flag, grade, km = f"{c}__gap_filled", f"{c}__confidence", f"{c}__nearest_monitor_km"
        if flag not in panel.columns or grade not in panel.columns:
            continue
        lowered = C.downgrade(F.col(grade))
        if c in P.AIR_QUALITY and km in panel.columns:
            lowered = F.when(F.col(km) > 50, C.downgrade(F.col(grade), 2)).when(F.col(km) <= 50, lowered).otherwise(
                F.col(grade)
            )
        changed[grade] = F.when(F.col(flag), lowered).otherwise(F.col(grade))
    return panel.withColumns(changed) if changed else panel


def carry_forward_health(panel: DataFrame, target_year: int) -> DataFrame:
    """Health burden of the target year from the county's latest figure, grade C."""
    if "health_burden" not in panel.columns:
        return panel
    grade = "health_burden__confidence"
    auxiliary = [
        c for c in panel.columns
        if c.startswith("health_burden__") and c not in (grade, "health_burden__attribution")
    ]
    return windows.carry_forward_latest(
        panel, "health_burden", target_year, auxiliary, grade if grade in panel.columns else None
    )


def zero_fill_payout(panel: DataFrame) -> DataFrame:
    """No payout record means no payout, wherever the county has any other value."""
    if "fema_ia_burden" not in panel.columns:
        return panel
    others = [F.col(c).isNotNull() for c in P.COMPONENT_IDS if c in panel.columns and c != "fema_ia_burden"]
    fill = F.col("fema_ia_burden").isNull() & reduce(lambda a, b: a | b, others, F.lit(False))
    zeros = ["fema_ia_burden"] + [
        f"fema_ia_burden__{a}" for a in P.COMPONENT_SOURCES["fema_ia_burden"][2]
        if f"fema_ia_burden__{a}" in panel.columns
    ]
    changed = {c: F.when(fill, F.lit(0).cast(panel.schema[c].dataType)).otherwise(F.col(c)) for c in zeros}
    if "fema_ia_burden__confidence" in panel.columns:
        grade = "fema_ia_burden__confidence"
        changed[grade] = F.when(fill, F.lit("A")).otherwise(F.col(grade))
    return panel.withColumns(changed)


def harmonize(tables: dict[str, DataFrame], target_year: int, centroids: DataFrame | None = None) -> DataFrame:
    """The complete panel: merge, provenance, gap fills, recount, drop empty rows."""
    panel = add_provenance(merge_components(tables))
    if centroids is not None:
        panel = downgrade_by_distance(idw_gap_fill(panel, centroids))
    panel = zero_fill_payout(carry_forward_health(panel, target_year))
    present = [c for c in P.COMPONENT_IDS if c in panel.columns]
    return panel.withColumn("component_count", C.present_count(present)).where(F.col("component_count") > 0)


def sort_output(panel: DataFrame) -> DataFrame:
    """Rows in county and year order (a range-partitioned sort)."""
    return panel.orderBy("fips", "year")
