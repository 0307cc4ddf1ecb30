"""Sensitivity analysis: every variant is a ``scenario`` value in one job."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions.pvalues import correlation_pvalue
from hearthline.operators import draws, rollups, stats, windows
from hearthline.operators.order_stats import quantiles, with_ranks
from hearthline.plans import index as I
from hearthline.storage import materialize

UNIT = I.UNIT


def compare_rankings(
    primary: DataFrame, alternatives: DataFrame, kendall: bool = True, top: int = 10, same_units: bool = False
) -> DataFrame:
    """Rank agreement of each scenario with the primary scores.

    ``primary`` has ``fips, index_score``; ``alternatives`` also ``scenario``.
    Ranks are taken over the counties both share; fewer than two give NULL.  With ``same_units`` every scenario
    scores exactly the primary counties, and ``primary`` brings their ``primary_rank`` and ``_rx``.
    """
    shared = alternatives.select("scenario", "fips", F.col("index_score").alias("y")).join(
        primary.select("fips", F.col("index_score").alias("x"), *(["primary_rank", "_rx"] if same_units else [])), "fips"
    )
    # Both rankings, the shifts and tau read these rows.
    shared = materialize(shared, "rankings")
    ranked = shared if same_units else with_ranks(shared, ["scenario"], "x", {"primary_rank": "min", "_rx": "average"})
    ranked = with_ranks(ranked, ["scenario"], "y", {"alt_rank": "min", "_ry": "average"})
    shift = ranked.withColumn("shift", F.abs(F.col("alt_rank") - F.col("primary_rank")))
    summary = shift.groupBy("scenario").agg(
        stats.pearson("_rx", "_ry").alias("spearman_r"),
        correlation_pvalue(stats.pearson("_rx", "_ry"), F.count(F.lit(1))).alias("spearman_p"),
        F.count(F.lit(1)).alias("n_shared"),
        F.max("shift").alias("max_rank_shift"),
        F.count_if(F.col("shift") > 10).alias("n_shifted_gt_10"),
        F.count_if(F.col("shift") > 15).alias("n_shifted_gt_15"),
    )
    # Spark keeps at most ``top`` rows per scenario and task before the shuffle.
    order = Window.partitionBy("scenario").orderBy(F.col("shift").desc(), "fips")
    first = shift.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)
    shifted = first.groupBy("scenario").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_place", "fips", "primary_rank", "alt_rank", "shift"))),
            lambda e: F.struct(e["fips"].alias("fips"), e["primary_rank"].alias("primary_rank"),
                               e["alt_rank"].alias("alt_rank"), e["shift"].alias("shift")),
        ).alias("top_shifted")
    )
    result = summary.join(shifted, "scenario", "left")
    if kendall:
        result = result.join(stats.kendall_tau_b(shared, ["scenario"]), "scenario", "left").withColumnRenamed(
            "tau", "kendall_tau"
        )
    return result


def primary_scores(ready: I.Prepared, settings: P.Settings, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary index ``(fips, index_score)`` and its scale."""
    parts = I.component_scores(I.contributions(ready.centered, ready.penalties, ready.accelerations), weights)
    scored, k = I.composite(parts, settings)
    return scored.drop("scenario"), k


class Shared(NamedTuple):
    """Stored steps that every sensitivity test reads and none changes."""

    ready: I.Prepared
    #: Contributions under the base penalties and trends.
    parts: DataFrame
    #: ``fips, index_score, primary_rank, _rx`` of the primary index.
    primary: DataFrame
    k: DataFrame


def share(ready: I.Prepared, settings: P.Settings) -> Shared:
    """Store contributions, primary scores with their ranks, and the scale once for all tests."""
    weights = base_weights_frame(ready.panel.sparkSession)
    parts = materialize(I.contributions(ready.centered, ready.penalties, ready.accelerations), "contributions")
    scored, k = I.composite(I.component_scores(parts, weights), settings)
    scored = scored.select("scenario", "fips", "index_score")
    ranked = with_ranks(scored, ["scenario"], "index_score", {"primary_rank": "min", "_rx": "average"})
    return Shared(ready, parts, materialize(ranked.drop("scenario"), "primary"), materialize(k, "scale"))


def _shared(ready: I.Prepared | Shared, settings: P.Settings) -> Shared:
    return ready if isinstance(ready, Shared) else share(ready, settings)


def rescored(contributions: DataFrame, schemes: DataFrame, settings: P.Settings) -> DataFrame:
    """Scores of each weighting scheme over the same contributions, k recalibrated."""
    parts = contributions.drop("scenario").join(schemes, "component").select(
        *UNIT, "component", (F.col("value") * F.col("weight")).alias("score")
    )
    return I.composite(parts, settings)[0]


def base_weights_frame(spark: SparkSession) -> DataFrame:
    return P.registry_frame(spark).select("component", "weight")


# --- leave one out ------------------------------------------------------------


def jackknife_schemes(weights: dict[str, float]) -> dict[str, dict[str, float]]:
    """One scheme per component: the others scaled to one, itself at zero."""
    schemes = {}
    for dropped in weights:
        rest = sum(w for c, w in weights.items() if c != dropped)
        if rest:
            schemes[dropped] = {c: 0.0 if c == dropped else w / rest for c, w in weights.items()}
    return schemes


def left_out(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Raw composite ``(scenario, fips, raw_composite)`` without each component in turn.

    With ``S`` the weighted sum of a county and ``T`` the sum of weights, leaving ``j`` out and scaling the other
    weights to one gives ``(S - v_j w_j) / (T - w_j)``, so no table of weighting schemes is joined.  A component that carries all
    weight has no rest to scale and is no scenario.
    """
    total = sum(weights.values())
    names = list(jackknife_schemes(weights))
    # One row per county; a component without a value weighs nothing.  Sums have a fixed order, so equal counties tie.
    scored = parts.groupBy("fips").agg(
        *[F.sum(F.when(F.col("component") == c, F.col("value") * F.lit(w))).alias(f"_at_{c}") for c, w in weights.items()]
    )
    scored = scored.withColumn("_all", reduce(lambda x, y: x + y, [F.coalesce(f"_at_{c}", F.lit(0.0)) for c in weights]))
    rest = [
        F.struct(
            F.lit(c).alias("scenario"),
            ((F.col("_all") - F.coalesce(f"_at_{c}", F.lit(0.0))) / F.lit(total - weights[c])).alias("raw_composite"),
        )
        for c in names
    ]
    return scored.select("fips", F.inline(F.array(*rest))).select("scenario", "fips", "raw_composite")


def jackknife(ready: I.Prepared | Shared, settings: P.Settings) -> DataFrame:
    """Rank change when each component is left out."""
    base = _shared(ready, settings)
    raw = materialize(left_out(base.parts, P.base_weights()), "left_out")
    alternatives = I.scaled(raw, settings)[0]
    return compare_rankings(base.primary, alternatives, kendall=False, same_units=True).select(
        F.col("scenario").alias("excluded_component"), "spearman_r", "max_rank_shift", "n_shifted_gt_10",
        F.col("top_shifted").alias("most_affected_counties"),
    )


# --- alternative weightings -----------------------------------------------------


def alternative_weightings(ready: I.Prepared | Shared, settings: P.Settings) -> DataFrame:
    """Equal and risk weights, and the base weights without acceleration.

    The method lists the last scheme under two names; both are kept.
    """
    shared = _shared(ready, settings)
    ready, moving = shared.ready, shared.parts
    spark = ready.panel.sparkSession
    base = P.base_weights()
    equal = {c: 1.0 / len(P.REGISTRY) for c in base}
    neutral = I.contributions(ready.centered, ready.penalties, None)
    weighted = P.weights_frame(spark, {"equal": equal, "pure_risk": P.RISK_WEIGHTS})
    unmoved = P.weights_frame(spark, {"pure_budget": base, "neutral_acceleration": base})
    scored = rescored(moving, weighted, settings).unionByName(rescored(neutral, unmoved, settings))
    scored = materialize(scored, "reweighted")
    spread = quantiles(
        scored, ["scenario"], "index_score", {"iqr_low": 0.25, "median_index_score": 0.5, "iqr_high": 0.75}
    )
    return (
        compare_rankings(shared.primary, scored, kendall=False, same_units=True)
        .join(spread, "scenario")
        .select(
            F.col("scenario").alias("scheme"), F.col("spearman_r").alias("spearman_r_vs_primary"), "max_rank_shift",
            "n_shifted_gt_10", "median_index_score", "iqr_low", "iqr_high",
        )
    )


# --- overlap threshold ------------------------------------------------------------


def threshold_sweep(ready: I.Prepared | Shared, settings: P.Settings, thresholds=(0.5, 0.6, 0.7)) -> DataFrame:
    """Index under several overlap thresholds.

    ``n_penalized`` counts components with a penalty below one (the method calls
    the same number flagged pairs).
    """
    base = _shared(ready, settings)
    ready = base.ready
    spark = ready.panel.sparkSession
    weights = base_weights_frame(spark)
    table = spark.createDataFrame([(str(t), float(t)) for t in thresholds], "sweep string, threshold double")
    # The pair table has 66 rows; each meets the fixed list of thresholds.
    swept = ready.pairs.drop("scenario").withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    ).join(table, "threshold").withColumnRenamed("sweep", "scenario")
    flagged = I.flagged_pairs(swept, 0.0).join(
        table.withColumnRenamed("sweep", "scenario"), "scenario"
    ).where(I.over_threshold(F.col("r"), F.col("threshold")))
    penalties = I.overlap_penalties(flagged, settings.overlap_floor)
    fanned = ready.centered.drop("scenario").withColumn(
        "scenario", F.explode(F.array(*[F.lit(str(t)) for t in thresholds]))
    )
    accel = ready.accelerations.drop("scenario").withColumn(
        "scenario", F.explode(F.array(*[F.lit(str(t)) for t in thresholds]))
    )
    parts = I.component_scores(I.contributions(fanned, penalties, accel), weights)
    scored, _ = I.composite(parts, settings)
    compared = compare_rankings(base.primary, scored, kendall=False, same_units=True)
    counted = penalties.groupBy("scenario").agg(
        F.count_if(F.col("penalty") < 1).alias("n_penalized"),
        F.map_from_entries(F.collect_list(F.struct("component", "penalty"))).alias("penalties"),
    )
    return compared.join(counted, "scenario", "left").select(
        F.col("scenario").cast("double").alias("threshold"),
        F.coalesce("n_penalized", F.lit(0)).alias("n_penalized"),
        F.col("spearman_r").alias("spearman_r_vs_primary"),
        "max_rank_shift",
        "n_shifted_gt_10",
        "penalties",
    )


# --- normalization ----------------------------------------------------------------


def normalization_compare(ready: I.Prepared | Shared, settings: P.Settings) -> DataFrame:
    """Percentile against z-score normalization with the primary penalties and trends."""
    base = _shared(ready, settings)
    ready = base.ready
    weights = base_weights_frame(ready.panel.sparkSession)
    current = ready.panel.where(F.col("year") == settings.scoring_year)
    scaled = windows.zscore_normalize(
        I.winsorized_universe(current, settings), ["scenario", "component"]
    )
    parts = I.component_scores(I.contributions(scaled, ready.penalties, ready.accelerations), weights)
    scored, _ = I.composite(parts, settings)
    both = scored.select(F.lit("z_score").alias("scenario"), "fips", "index_score").unionByName(
        base.primary.select(F.lit("percentile").alias("scenario"), "fips", "index_score")
    )
    return compare_rankings(base.primary, both, same_units=True).select(
        F.col("scenario").alias("normalization"), F.col("spearman_r").alias("spearman_r_vs_primary"), "kendall_tau",
        "max_rank_shift", "n_shifted_gt_10",
    )


# --- full recomputations ------------------------------------------------------------


def fan_out(panel: DataFrame, variants: dict[str, dict[str, Column]]) -> DataFrame:
    """The panel once per scenario with some columns replaced."""
    base = panel.drop("scenario")
    changed = {c for changes in variants.values() for c in changes}
    entries = [
        F.struct(F.lit(name).alias("scenario"), *[changes.get(c, F.col(c)).cast("double").alias(c) for c in sorted(changed)])
        for name, changes in variants.items()
    ]
    return base.withColumn("_variant", F.explode(F.array(*entries))).select(
        *[c for c in base.columns if c not in changed], "_variant.*"
    )


def full_variants(
    panel: DataFrame, variants: dict[str, dict[str, Column]], settings: P.Settings
) -> DataFrame:
    """All ten steps for each variant of the panel, in one run keyed by scenario."""
    ready = I.prepare(fan_out(panel, variants), settings)
    weights = base_weights_frame(panel.sparkSession)
    parts = I.component_scores(I.contributions(ready.centered, ready.penalties, ready.accelerations), weights)
    return materialize(I.composite(parts, settings)[0], "variants")


def changed_component(base: Shared, settings: P.Settings, component: str, variants: dict[str, Column]) -> DataFrame:
    """Index scores of each variant of one component, computed from what depends on it.

    ``variants`` maps a scenario to the component's new column, which must be NULL in the same rows as before, so the
    universe stays.  Only this component's cut, rank and trend and its pairs are computed again; the others' centered
    values, trends and pairs are those of the base.
    """
    ready, spark = base.ready, base.ready.panel.sparkSession
    others = [c for c in ready.components if c != component]
    panel = ready.panel.drop("scenario")
    columns = [c for c in panel.columns if c in ("fips", "year") or c in P.COMPONENT_IDS]
    fanned = materialize(fan_out(panel.select(*columns), {name: {component: value} for name, value in variants.items()}), "changed")
    current = fanned.where(F.col("year") == settings.scoring_year)
    new = materialize(I.center(I.percentile_rank(I.winsorized_universe(current, settings, [component]))), "recentered")
    trend = materialize(I.accelerations(fanned, [component], settings, P.registry_frame(spark)), "retrend")
    # Pairs of the component: its new values beside the others' unchanged ones.
    wide = I.to_wide(ready.centered.drop("scenario"), others, ["fips"])
    beside = new.select("scenario", "fips", F.col("value").alias(component)).join(wide, "fips")
    pairs = stats.pearson_pairs(beside, ["scenario"], ready.components, only=component)
    kept = ready.pairs.drop("scenario").where((F.col("a") != component) & (F.col("b") != component))
    names = F.explode(F.array(*[F.lit(n) for n in variants]))
    pairs = pairs.unionByName(kept.withColumn("scenario", names))
    penalties = materialize(I.overlap_penalties(I.flagged_pairs(pairs, settings.overlap_threshold), settings.overlap_floor), "repenalized")
    fan = lambda df: df.drop("scenario").where(F.col("component") != component).withColumn("scenario", names)
    centered = fan(ready.centered).unionByName(new)
    accel = fan(ready.accelerations).unionByName(trend)
    parts = I.component_scores(I.contributions(centered, penalties, accel), base_weights_frame(spark))
    return I.composite(parts, settings)[0]


def severity_perturbation(
    panel: DataFrame | Shared, settings: P.Settings, factors=(0.75, 0.875, 1.0, 1.125, 1.25)
) -> DataFrame:
    """Index with storm severity scaled up and down."""
    base = panel if isinstance(panel, Shared) else share(I.prepare(panel, settings), settings)
    if "storm_severity" in base.ready.components:
        variants = {str(f): F.col("storm_severity") * float(f) for f in factors}
        scored = changed_component(base, settings, "storm_severity", variants)
    else:
        names = F.explode(F.array(*[F.lit(str(f)) for f in factors]))
        scored = base.primary.select("fips", "index_score").withColumn("scenario", names)
    return compare_rankings(base.primary, scored, kendall=False, same_units=True).select(
        F.col("scenario").cast("double").alias("perturbation_factor"),
        F.col("spearman_r").alias("spearman_r_vs_primary"),
        "max_rank_shift",
        "n_shifted_gt_10",
    )


# Columns holding anomalies against the other normals period.
ALTERNATIVE_BASELINE = {"hdd_anomaly": "hdd_anomaly__1981_2010", "cdd_anomaly": "cdd_anomaly__1981_2010"}
BASELINE_SCHEMA = (
    "baseline string, spearman_r_vs_primary double, max_rank_shift long, n_shifted_gt_10 long, status string"
)


def baseline_comparison(panel: DataFrame, settings: P.Settings, alternative: DataFrame | None = None) -> DataFrame:
    """Index against the 1981-2010 normals, where those anomalies are available.

    They may be columns of the panel, or a table keyed by county and year.
    """
    spark = panel.sparkSession
    own = spark.createDataFrame([("1991-2020", 1.0, 0, 0, "primary")], BASELINE_SCHEMA)
    if alternative is not None and not set(ALTERNATIVE_BASELINE.values()) <= set(panel.columns):
        named = [F.col(new if new in alternative.columns else old).alias(new) for old, new in ALTERNATIVE_BASELINE.items()]
        panel = panel.join(alternative.select("fips", "year", *named), ["fips", "year"], "left")
    if not set(ALTERNATIVE_BASELINE.values()) <= set(panel.columns):
        absent = spark.createDataFrame([("1981-2010", None, None, None, "data_unavailable")], BASELINE_SCHEMA)
        return own.unionByName(absent)
    swapped = {old: F.col(new) for old, new in ALTERNATIVE_BASELINE.items()}
    scored = full_variants(panel, {"primary": {}, "1981-2010": swapped}, settings)
    primary = scored.where(F.col("scenario") == "primary").drop("scenario")
    compared = compare_rankings(primary, scored.where(F.col("scenario") != "primary"), kendall=False)
    return own.unionByName(
        compared.select(
            F.col("scenario").alias("baseline"), F.col("spearman_r").alias("spearman_r_vs_primary"),
            F.col("max_rank_shift").cast("long").alias("max_rank_shift"), "n_shifted_gt_10", F.lit("computed").alias("status"),
        )
    )


# --- trend windows --------------------------------------------------------------


def window_sensitivity(ready: I.Prepared | Shared, settings: P.Settings, lengths=(3, 5, 7, 10)) -> DataFrame:
    """Index under several trend windows; static components keep theirs."""
    base = _shared(ready, settings)
    ready = base.ready
    spark = ready.panel.sparkSession
    weights = base_weights_frame(spark)
    tables = [
        P.registry_frame(spark, P.registry_with_windows(w)).select("component", "window").withColumn("scenario", F.lit(str(w)))
        for w in lengths
    ]
    table = reduce(lambda a, b: a.unionByName(b), tables)
    fan = lambda df: df.drop("scenario").withColumn("scenario", F.explode(F.array(*[F.lit(str(w)) for w in lengths])))
    # A component's trend depends on its window alone; scenarios share those of equal windows.
    table = table.where(F.col("component").isin(ready.components))
    moved = I.window_accelerations(ready.panel, ready.components, settings, table.select("component", "window").distinct())
    accel = materialize(moved.drop("scenario").join(table, ["component", "window"]), "windows")
    penalties = fan(ready.penalties)
    parts = I.component_scores(I.contributions(fan(ready.centered), penalties, accel), weights)
    scored, _ = I.composite(parts, settings)
    # Components and counties without a multiplier count as one in the score and in this summary.
    units = fan(ready.panel.select("scenario", "fips").distinct()).withColumn(
        "component", F.explode(F.array(*[F.lit(c) for c in ready.components]))
    )
    full = units.join(accel.select(*UNIT, "component", "acceleration"), [*UNIT, "component"], "left").withColumn(
        "acceleration", F.coalesce("acceleration", F.lit(1.0))
    )
    spread = rollups.acceleration_distribution(full, ["scenario"], settings.accel_low, settings.accel_high)
    return (
        compare_rankings(base.primary, scored, kendall=False, same_units=True)
        .join(spread, "scenario")
        .select(
            F.col("scenario").cast("int").alias("window_years"), F.col("spearman_r").alias("spearman_r_vs_primary"),
            "max_rank_shift", "median_acceleration", "pct_at_lower_bound", "pct_at_upper_bound",
        )
    )


# --- Monte Carlo ------------------------------------------------------------------

# Modulus and multipliers of the draw.
_PRIME, _MUL_DRAW, _MUL_PLACE, _MUL_SEED = 2147483647, 48271, 69621, 16807


def uniform_draw(draw: Column, place: int, seed: int) -> Column:
    """Repeatable uniform number in [0, 1) from integers alone.

    Plain modular arithmetic, so the same draw can be stated in any SQL dialect
    and does not depend on partitioning.
    """
    mixed = (draw.cast("long") * _MUL_DRAW + F.lit(place * _MUL_PLACE + seed * _MUL_SEED + 1)) % _PRIME
    for shift in (12345, 67891):
        mixed = (mixed * mixed + mixed * _MUL_PLACE + shift) % _PRIME
    return mixed / float(_PRIME)


def with_perturbed_weights(draws: DataFrame, weights: dict[str, float], perturbation: float, seed: int = 42) -> DataFrame:
    """Add ``weights`` of each ``iteration``: every weight scaled by a draw in 1 ± perturbation, then to sum one."""
    drawn = [
        F.lit(w) * (F.lit(1.0 - perturbation) + 2.0 * perturbation * uniform_draw(F.col("iteration"), place, seed))
        for place, w in enumerate(weights.values())
    ]
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)
    return draws.withColumn("_w", F.array(*drawn)).withColumn("weights", F.transform("_w", lambda w: w / total)).drop("_w")


def perturbed_weights(
    spark: SparkSession, weights: dict[str, float], iterations: int, perturbation: float, seed: int = 42
) -> DataFrame:
    """``(iteration, weights)`` of all draws."""
    numbered = spark.range(iterations).select(F.col("id").cast("int").alias("iteration"))
    return with_perturbed_weights(numbered, weights, perturbation, seed)


class MonteCarlo:
    """Lazy results of a weight perturbation run."""

    def __init__(self, detail: DataFrame, summary: DataFrame, agreement: DataFrame):
        self.detail, self.summary, self.draws = detail, summary, agreement


def unit_blocks(base: Shared, names: list[str]) -> DataFrame:
    """``(block, units, k)``: counties in blocks, each with contributions in the order of ``names`` and primary place."""
    values = [F.coalesce(F.sum(F.when(F.col("component") == c, F.col("value"))), F.lit(0.0)) for c in names]
    units = base.parts.groupBy("fips").agg(F.array(*values).alias("values")).join(
        base.primary.select("fips", "primary_rank", F.col("_rx").alias("place")), "fips"
    )
    return draws.blocks_of(units, "fips", base.primary.count()).crossJoin(base.k.select("k"))


def ranked_draws(orders: DataFrame) -> DataFrame:
    """``(iteration, unit, rank, mean_place)`` from each draw's units in the order of their scores.

    A unit alone at its score has the rank of its place.  Only units that share a score are grouped.
    """
    near = lambda x, i: F.get("order", i)["score"].eqNullSafe(x["score"])
    marked = F.transform("order", lambda x, i: F.struct(x["unit"].alias("unit"), x["score"].alias("score"), (near(x, i - 1) | near(x, i + 1)).alias("tied")))
    placed = orders.select("iteration", F.posexplode(marked).alias("place", "one")).select("iteration", F.col("place") + 1, "one.*")
    placed = placed.toDF("iteration", "place", "unit", "score", "tied")
    alone = placed.where(~F.col("tied")).select("iteration", "unit", F.col("place").alias("rank"), F.col("place").cast("double").alias("mean_place"))
    ties = placed.where("tied").groupBy("iteration", "score").agg(
        F.min("place").alias("rank"), F.avg("place").alias("mean_place"), F.collect_list("unit").alias("unit")
    )
    return alone.unionByName(ties.select("iteration", F.explode("unit").alias("unit"), "rank", "mean_place"))


def monte_carlo_weights(
    ready: I.Prepared | Shared, settings: P.Settings, iterations: int | None = None, perturbation: float | None = None,
    seed: int = 42, flag_share: float = 0.15,
) -> MonteCarlo:
    """Rank spread of each county under random weights, with the primary scale.

    Counties are scored in blocks, ranked within each draw, and their ranks turned back to their blocks.
    """
    base = _shared(ready, settings)
    spark = base.parts.sparkSession
    iterations = iterations or settings.monte_carlo_iterations
    perturbation = settings.perturbation if perturbation is None else perturbation
    weights = P.base_weights()
    blocks = materialize(unit_blocks(base, list(weights)), "blocks")
    # As many rows as draws, whatever the input.
    drawn = perturbed_weights(spark, weights, iterations, perturbation, seed).orderBy("iteration").collect()
    ranked = draws.ranked(draws.scored(blocks, np.array([row["weights"] for row in drawn])))
    units = blocks.select("block", F.posexplode("units").alias("position", "_one")).select("block", "position", "_one.fips", "_one.primary_rank")
    counted = base.primary.agg(F.count(F.lit(1)).alias("_units"))
    m = F.col("n")
    detail = draws.spread(ranked).join(units, ["block", "position"]).crossJoin(counted).select(
        "fips", "primary_rank",
        (F.col("total") / m).alias("mean_rank"),
        (F.sqrt(m * F.col("squares") - F.col("total") * F.col("total")) / m).alias("rank_std"),
        F.col("p05").alias("rank_p05"), F.col("p95").alias("rank_p95"),
        F.col("shift").alias("max_rank_shift"),
        (F.col("shift") > F.lit(flag_share) * F.col("_units")).alias("is_flagged"),
    )
    agreement = ranked.groupBy("iteration").agg(F.max("r").alias("spearman_r"))
    levels = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    summary = agreement.groupBy().agg(
        F.count(F.lit(1)).alias("n_iterations"),
        *[F.percentile("spearman_r", p).alias(name) for name, p in levels.items()],
        F.avg("spearman_r").alias("mean"),
    )
    return MonteCarlo(detail, summary, agreement)


# --- report ------------------------------------------------------------------------

REPORT_COLUMNS = ["test_name", "variant", "spearman_r_vs_primary", "max_rank_shift", "n_flagged_counties", "status"]


def report_rows(
    table: DataFrame, test_name: str, variant: Column, r: str, shift: str = "max_rank_shift",
    flagged: str | None = "n_shifted_gt_10", status: Column | None = None,
) -> DataFrame:
    """A scenario result in the common report columns."""
    return table.select(
        F.lit(test_name).alias("test_name"),
        variant.cast("string").alias("variant"),
        F.col(r).cast("double").alias("spearman_r_vs_primary"),
        F.col(shift).cast("double").alias("max_rank_shift"),
        (F.col(flagged).cast("long") if flagged else F.lit(0).cast("long")).alias("n_flagged_counties"),
        (status if status is not None else F.lit("success")).alias("status"),
    )


def monte_carlo_row(result: MonteCarlo) -> DataFrame:
    """Report row of a Monte-Carlo run: median agreement, 95th percentile shift, flagged counties."""
    detail = result.detail.withColumn("variant", F.lit("monte_carlo"))
    flagged = detail.groupBy("variant").agg(F.count_if("is_flagged").alias("n_flagged"))
    shifts = quantiles(detail, ["variant"], "max_rank_shift", {"max_rank_shift": 0.95}).join(flagged, "variant")
    agreement = result.summary.withColumn("variant", F.lit("monte_carlo"))
    return report_rows(
        agreement.join(shifts, "variant"), "weight_perturbation", F.col("variant"), "p50", flagged="n_flagged"
    )


def robustness_label(report: DataFrame) -> DataFrame:
    """One row: label by the lowest agreement of the deterministic tests below one."""
    considered = (
        (F.col("test_name") != "weight_perturbation")
        & (F.col("status") == "success")
        & (F.col("spearman_r_vs_primary") < 1.0)
    )
    lowest = F.min(F.when(considered, F.col("spearman_r_vs_primary")))
    return report.agg(
        lowest.alias("min_spearman_r"),
        F.when(lowest.isNull(), F.lit("insufficient_data"))
        .when(lowest > 0.9, F.lit("robust"))
        .when(lowest > 0.8, F.lit("moderately_robust"))
        .otherwise(F.lit("fragile"))
        .alias("robustness"),
    )


def sensitivity_report(panel: DataFrame, settings: P.Settings, iterations: int | None = None) -> DataFrame:
    """All eight tests in the common report columns, over one store of the steps they share."""
    base = share(I.prepare(panel, settings), settings)
    r = "spearman_r_vs_primary"
    baseline = baseline_comparison(panel, settings)
    parts = [
        monte_carlo_row(monte_carlo_weights(base, settings, iterations)),
        report_rows(
            jackknife(base, settings), "jackknife", F.concat(F.lit("drop_"), "excluded_component"), "spearman_r"
        ),
        report_rows(alternative_weightings(base, settings), "alt_weighting", F.col("scheme"), r),
        report_rows(threshold_sweep(base, settings), "correlation_threshold", F.col("threshold"), r),
        report_rows(normalization_compare(base, settings), "normalization", F.col("normalization"), r),
        report_rows(severity_perturbation(base, settings), "severity_perturbation", F.col("perturbation_factor"), r),
        report_rows(window_sensitivity(base, settings), "window_sensitivity", F.col("window_years"), r, flagged=None),
        report_rows(baseline, "baseline_comparison", F.col("baseline"), r, status=F.col("status")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
