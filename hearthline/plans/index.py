"""The ten scoring steps from the harmonized panel to the index.

Working form is long: one row per scenario, county and component, observed
values only.  ``scenario`` leads every key, so one run can score many variants.
The two stored tables (panel slice and centered values) cut the plan where many
later steps read the same rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import columns as C
from hearthline.operators import rollups, stats, windows
from hearthline.operators.order_stats import quantiles, with_rank
from hearthline.sources.readers import latest_vintage
from hearthline.storage import materialize

UNIT = ["scenario", "fips"]


class Prepared(NamedTuple):
    """Everything that does not depend on weights."""

    panel: DataFrame
    components: list[str]
    centered: DataFrame
    pairs: DataFrame
    penalties: DataFrame
    accelerations: DataFrame


class IndexResult(NamedTuple):
    """Result bundle; every member is a DataFrame."""

    scores: DataFrame
    components: DataFrame
    penalties: DataFrame
    accelerations: DataFrame
    correlation: DataFrame
    k: DataFrame
    national: DataFrame
    strain: DataFrame
    dollar: DataFrame
    universe: DataFrame


def components_of(panel: DataFrame) -> list[str]:
    return [c for c in P.COMPONENT_IDS if c in panel.columns]


def with_scenario(panel: DataFrame, name: str = "primary") -> DataFrame:
    return panel if "scenario" in panel.columns else panel.withColumn("scenario", F.lit(name))


def transform_inputs(panel: DataFrame, registry=P.REGISTRY) -> DataFrame:
    """Step 1: log, root or identity per component."""
    rules = {c.id: c.transform for c in registry if c.id in panel.columns and c.transform != "identity"}
    return panel.withColumns({c: C.transformed(F.col(c).cast("double"), rule) for c, rule in rules.items()})


def observed_long(panel: DataFrame, components: list[str]) -> DataFrame:
    """Observed values as rows, with the county's universe membership."""
    marked = panel.withColumn("in_universe", C.in_universe())
    wide = marked.select(*UNIT, "in_universe", *[F.col(c).cast("double").alias(c) for c in components])
    return wide.unpivot([*UNIT, "in_universe"], components, "component", "value").where(F.col("value").isNotNull())


def define_universe(panel: DataFrame) -> DataFrame:
    """Step 3a: counties complete enough to score."""
    return panel.where(C.in_universe()).select(*UNIT)


def percentile_rank(long: DataFrame) -> DataFrame:
    """Step 3b: average-tie percentile rank per component, 0 to 100."""
    ranked = with_rank(long, ["scenario", "component"], "value", "_pct", "pct")
    return ranked.withColumn("value", F.col("_pct")).drop("_pct")


def center(long: DataFrame, subtract: float = 50.0) -> DataFrame:
    """Step 4: percentiles around zero."""
    return long.withColumn("value", F.col("value") - subtract)


def winsorized_universe(panel: DataFrame, settings: P.Settings, components: list[str] | None = None) -> DataFrame:
    """Steps 1 to 3a: transformed values, cut at the percentile over all counties, universe only."""
    long = observed_long(transform_inputs(panel), components or components_of(panel))
    cut = windows.winsorize_upper(long, ["scenario", "component"], settings.winsorize_percentile)
    return cut.where("in_universe").select(*UNIT, "component", "value")


def to_wide(long: DataFrame, components: list[str], keys: list[str] = UNIT) -> DataFrame:
    return long.groupBy(*keys).pivot("component", list(components)).agg(F.first("value"))


def impute_and_downgrade(wide: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """Step 7: missing preferred components score neutral and lose a confidence step."""
    changed = {}
    for c, neutral in (rules or {c: 0.0 for c in P.PREFERRED}).items():
        if c not in wide.columns:
            continue
        changed[c] = F.coalesce(F.col(c), F.lit(float(neutral)))
        grade = f"{c}__confidence"
        if grade in wide.columns:
            changed[grade] = F.when(F.col(c).isNull(), C.downgrade(F.col(grade))).otherwise(F.col(grade))
    flag, grade = "flood_exposure__map_currency_flag", "flood_exposure__confidence"
    if flag in wide.columns and grade in wide.columns:
        changed[grade] = F.when(F.col(flag) == 1, F.lit("B")).otherwise(changed.get(grade, F.col(grade)))
    return wide.withColumns(changed) if changed else wide


def precedence(registry=P.REGISTRY) -> dict[str, int]:
    """Order in which components win an overlap: tier, then confidence, then weight."""
    order = sorted(registry, key=lambda c: (c.tier, c.confidence, -c.weight))
    return {c.id: i for i, c in enumerate(order)}


def over_threshold(r: Column, threshold: Column | float) -> Column:
    """Strictly above in absolute value; summation noise around an equal value does not count."""
    return F.round(F.abs(r), 12) > threshold


def flagged_pairs(
    pairs: DataFrame, threshold: float, alternatives: DataFrame | None = None, registry=P.REGISTRY
) -> DataFrame:
    """Overlapping pairs with ``winner``, ``loser``, ``r`` and the single-pair penalty.

    ``alternatives`` holds pair correlations by other methods; with it, a pair
    also counts when any of those exceeds the threshold (conservative mode).
    """
    place = lambda c: P.lookup(precedence(registry), F.col(c), 999)
    over = over_threshold(F.col("r"), threshold)
    if alternatives is not None:
        other = (
            alternatives.where(over_threshold(F.col("r"), threshold))
            .select("scenario", "a", "b")
            .distinct()
            .withColumn("_other", F.lit(True))
        )
        pairs = pairs.join(other, ["scenario", "a", "b"], "left")
        over = over | F.coalesce("_other", F.lit(False))
    first_wins = place("a") <= place("b")
    return pairs.where(F.col("r").isNotNull() & over).select(
        "scenario",
        F.when(first_wins, F.col("a")).otherwise(F.col("b")).alias("winner"),
        F.when(first_wins, F.col("b")).otherwise(F.col("a")).alias("loser"),
        "r",
        (1.0 - F.col("r") * F.col("r")).alias("raw_penalty"),
    )


def overlap_penalties(flagged: DataFrame, floor: float) -> DataFrame:
    """Step 5: product of the single-pair penalties of each loser, not below the floor.

    Components that lose no pair are absent and count as 1.
    """
    return flagged.groupBy("scenario", F.col("loser").alias("component")).agg(
        F.greatest(F.lit(float(floor)), F.product("raw_penalty")).alias("penalty")
    )


def accelerations(
    panel: DataFrame, components: list[str], settings: P.Settings, registry_table: DataFrame
) -> DataFrame:
    """Step 6: trend multipliers from the untransformed multi-year values."""
    return window_accelerations(panel, components, settings, registry_table).drop("window")


def window_accelerations(
    panel: DataFrame, components: list[str], settings: P.Settings, registry_table: DataFrame
) -> DataFrame:
    """Trend multipliers where ``registry_table`` may give a component several windows: adds ``window``."""
    wide = panel.select(*UNIT, "year", *[F.col(c).cast("double").alias(c) for c in components])
    long = wide.unpivot([*UNIT, "year"], components, "component", "value")
    slopes = windows.window_slopes(long, registry_table, settings.scoring_year, UNIT, settings.min_completeness)
    return windows.acceleration_multipliers(
        slopes, ["scenario", "window"], settings.accel_low, settings.accel_high, settings.accel_epsilon
    )


def prepare(panel: DataFrame, settings: P.Settings, registry=P.REGISTRY) -> Prepared:
    """Steps 1 to 6, shared by every weighting of the same panel."""
    components = components_of(panel)
    stored = materialize(with_scenario(panel), "panel")
    current = stored.where(F.col("year") == settings.scoring_year)
    centered = materialize(center(percentile_rank(winsorized_universe(current, settings))), "centered")
    # Pairs and trends are read by every later step, so they are computed once.
    pairs = materialize(stats.pearson_pairs(to_wide(centered, components), ["scenario"], components), "pairs")
    penalties = overlap_penalties(flagged_pairs(pairs, settings.overlap_threshold, registry=registry), settings.overlap_floor)
    accel = accelerations(stored, components, settings, P.registry_frame(panel.sparkSession, registry))
    accel = materialize(accel, "accelerations")
    return Prepared(stored, components, centered, pairs, penalties, accel)


def contributions(centered: DataFrame, penalties: DataFrame, accel: DataFrame | None) -> DataFrame:
    """Centered value times penalty times acceleration; missing factors are 1."""
    joined = centered.join(penalties.select("scenario", "component", "penalty"), ["scenario", "component"], "left")
    factor = F.coalesce("penalty", F.lit(1.0))
    if accel is not None:
        joined = joined.join(accel.select(*UNIT, "component", "acceleration"), [*UNIT, "component"], "left")
        factor = factor * F.coalesce("acceleration", F.lit(1.0))
    return joined.select(*UNIT, "component", (F.col("value") * factor).alias("value"))


def component_scores(parts: DataFrame, weights: DataFrame) -> DataFrame:
    """Step 8: contributions times weights.

    ``weights`` has ``component`` and ``weight``, and ``scenario`` when the
    weighting itself is what varies.
    """
    keys = ["component", *([c for c in ["scenario"] if c in weights.columns and c in parts.columns])]
    return parts.join(weights, keys).select(*UNIT, "component", (F.col("value") * F.col("weight")).alias("score"))


def composite(scores: DataFrame, settings: P.Settings, k: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Steps 9 and 10: sum per county, calibrate k, scale to 100 + k·S.

    A county's scores are added in the order of their components: counties with equal scores then have equal sums,
    whatever order their rows arrive in, and share their rank.
    """
    entries = F.collect_list(F.when(F.col("score").isNotNull(), F.struct("component", "score")))
    listed = scores.groupBy(*UNIT).agg(F.array_sort(entries).alias("_entries"))
    total = F.aggregate("_entries", F.lit(0.0), lambda acc, e: acc + e["score"])
    # The scale is taken from the same sums that it is applied to.
    raw = materialize(listed.select(*UNIT, F.when(F.size("_entries") > 0, total).alias("raw_composite")), "composite")
    return scaled(raw, settings, k)


def scaled(raw: DataFrame, settings: P.Settings, k: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Step 10 for raw composites: calibrate k unless given, scale to 100 + k·S."""
    scale = k if k is not None else rollups.calibrate_k(raw, ["scenario"], "raw_composite", settings.target_span)
    out = raw.join(scale, "scenario").select(
        *UNIT, (100.0 + F.col("k") * F.col("raw_composite")).alias("index_score"), "raw_composite"
    )
    return out, scale


def strain(scores: DataFrame, income: DataFrame) -> DataFrame:
    """Score per income, re-indexed so that its median is 100."""
    ratio = scores.join(income.select("fips", "median_household_income"), "fips").where(
        F.col("median_household_income") > 0
    ).select(*UNIT, (F.col("index_score") / F.col("median_household_income")).alias("_ratio"))
    middle = quantiles(ratio, ["scenario"], "_ratio", {"_median": 0.5})
    value = F.when(F.col("_median") > 0, F.col("_ratio") / F.col("_median") * 100.0).otherwise(F.lit(100.0))
    return ratio.join(middle, "scenario").select(*UNIT, value.alias("index_strain"))


def national(scores: DataFrame, units: DataFrame | None) -> DataFrame:
    """Housing-weighted national mean of the raw composite, or the plain mean."""
    if units is None:
        return scores.groupBy("scenario").agg(F.avg("raw_composite").alias("national"))
    joined = scores.join(units.select("fips", F.col("total_housing_units").alias("_units")), "fips", "left")
    return rollups.weighted_mean(joined, ["scenario"], "raw_composite", "_units")


def compute_index(
    panel: DataFrame, settings: P.Settings, census: DataFrame | None = None,
    weights: DataFrame | None = None, k: DataFrame | None = None, registry=P.REGISTRY,
) -> IndexResult:
    """All ten steps.  ``k`` may be given to freeze the scale of an earlier run.

    ``census`` may hold several years; the newest of the last five up to the scoring year counts.
    """
    spark = panel.sparkSession
    if census is not None and "year" in census.columns:
        # A county has one row: that of the newest vintage up to the scoring year.
        census = latest_vintage(census, settings.scoring_year).dropDuplicates(["fips"])
    ready = prepare(panel, settings, registry)
    if weights is None:
        weights = P.registry_frame(spark, registry).select("component", "weight")
    parts = component_scores(contributions(ready.centered, ready.penalties, ready.accelerations), weights)
    indexed, scale = composite(parts, settings, k)
    scored = materialize(indexed, "scores")
    current = ready.panel.where(F.col("year") == settings.scoring_year)
    tiers = current.select(*UNIT, C.quality_tier(current.columns).alias("data_quality_tier"))
    wide = impute_and_downgrade(parts.groupBy(*UNIT).pivot("component", ready.components).agg(F.first("score")))
    universe = define_universe(current)
    energy = "energy_cost_attributed"
    dollar = current.join(universe, UNIT, "left_semi").select(
        *UNIT, (F.col(energy) if energy in current.columns else F.lit(None)).cast("double").alias("index_dollar")
    )
    return IndexResult(
        scores=scored.join(tiers, UNIT),
        components=wide,
        penalties=ready.penalties,
        accelerations=ready.accelerations,
        correlation=ready.pairs,
        k=scale,
        national=national(scored, census),
        strain=strain(scored, census) if census is not None else scored.limit(0).select(
            *UNIT, F.lit(None).cast("double").alias("index_strain")
        ),
        dollar=dollar,
        universe=universe,
    )


def correlation_robustness(
    centered: DataFrame, components: list[str], threshold: float = 0.6
) -> DataFrame:
    """Pair correlations by four methods: ``scenario, a, b, method, r, flagged``."""
    wide = to_wide(centered, components)
    complete = wide.dropna(subset=components)
    pair_keys = ["scenario", "a", "b"]
    regional = centered.withColumn("region", P.lookup(P.REGION_OF_STATE, C.state_of(C.zero_pad(F.col("fips"), 5))))
    methods = {
        "pearson": stats.pearson_pairs(wide, ["scenario"], components),
        "spearman": stats.spearman(stats.pair_rows(wide, ["scenario"], components), pair_keys),
        "distance": stats.distance_correlation(
            stats.pair_rows(complete, ["scenario"], components), pair_keys
        ),
        "partial": stats.partial_pairs(regional, ["scenario"], "fips", "region", components),
    }
    stacked = [
        table.select(*pair_keys, F.lit(name).alias("method"), "r") for name, table in methods.items()
    ]
    out = stacked[0]
    for table in stacked[1:]:
        out = out.unionByName(table)
    return out.where(F.col("r").isNotNull()).withColumn("flagged", over_threshold(F.col("r"), threshold))


def correlation_discrepancies(by_method: DataFrame) -> DataFrame:
    """Pairs on which the methods disagree about the threshold."""
    return (
        by_method.groupBy("scenario", "a", "b")
        .agg(
            F.count(F.lit(1)).alias("n_methods"),
            F.count_if("flagged").alias("n_flagged"),
            F.map_from_entries(F.collect_list(F.struct("method", "r"))).alias("methods"),
        )
        .where((F.col("n_methods") >= 2) & (F.col("n_flagged") > 0) & (F.col("n_flagged") < F.col("n_methods")))
        .withColumn("conservative_flag", F.lit(True))
    )
