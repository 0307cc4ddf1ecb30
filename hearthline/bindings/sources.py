"""Readers and writers: raw layouts are derived from the tables, written, and read back.

Each query writes a file layout of the method to the scratch folder with Spark
and scans it with the reader under test; the SQL states the expected rows from
the original tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.bindings import scoring, validating
from hearthline.bindings import tables as T
from hearthline.bindings.registry import query, rounded, rounded_sql
from hearthline.functions import geometry as G
from hearthline.plans import index as I
from hearthline.plans import validation as V
from hearthline.sources import readers as R
from hearthline.sources import sinks as W
from hearthline.storage import materialize, scratch_path


def text(column) -> F.Column:
    return column.cast("string")


def as_csv(df: DataFrame, name: str, header: bool = True, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.options(header=header, **options).csv(path)
    return path


def as_json(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.json(path)
    return path


def as_text(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.select(F.col(df.columns[0]).alias("value")).write.text(path)
    return path


# --- parquet ---------------------------------------------------------------------------

PANEL_SLICE = ["fips", "year", "storm_severity", "drought_score"]


@query("scan_parquet_prefix", T.with_roles("panel") + "\nSELECT fips, year, storm_severity, drought_score FROM panel")
def scan_parquet_prefix(spark, d):
    """Yearly tables, with a sibling that must be left out."""
    panel = T.panel(spark, d).select(*PANEL_SLICE)
    root = scratch_path(spark, "prefix")
    panel = materialize(panel, "panel")
    for (year,) in panel.select("year").distinct().collect():
        panel.where(F.col("year") == year).write.parquet(f"{root}/storm_{year}.parquet")
    panel.select(F.col("fips").alias("storm_severity")).write.parquet(f"{root}/storm_normals.parquet")
    return R.parquet_prefix(spark, root, "storm")


@query("scan_year_partitions", T.with_roles("panel") + "\nSELECT fips, year, storm_severity, drought_score FROM panel WHERE year IN (1998, 2000)")
def scan_year_partitions(spark, d):
    root = scratch_path(spark, "partitions")
    W.write_year_partitions(T.panel(spark, d).select(*PANEL_SLICE), root, "storm")
    return R.parquet_years(spark, root, "storm", [1998, 2000]).select(*PANEL_SLICE)


@query("write_year_partitions", T.with_roles("panel") + "\nSELECT fips, year, CASE WHEN year = 2000 THEN storm_severity + 1 ELSE storm_severity END AS storm_severity FROM panel")
def write_year_partitions(spark, d):
    """A second write of one year replaces that year only."""
    root = scratch_path(spark, "partitions")
    panel = T.panel(spark, d).select("fips", "year", "storm_severity")
    path = W.write_year_partitions(panel, root, "storm")
    again = panel.where(F.col("year") == 2000).withColumn("storm_severity", F.col("storm_severity") + 1)
    W.write_year_partitions(again, root, "storm")
    return spark.read.parquet(path).select("fips", "year", "storm_severity")


@query(
    "write_metadata_sidecar",
    T.with_roles("panel") + "\nSELECT 'EXAMPLE' AS source, 'A' AS confidence, 'proxy' AS attribution, fips, count(*) AS n_years FROM panel GROUP BY fips",
)
def write_metadata_sidecar(spark, d):
    path = W.write_metadata(T.panel(spark, d), scratch_path(spark, "meta"), source="EXAMPLE", confidence="A", attribution="proxy")
    facts = spark.read.json(path).select("source", "confidence", "attribution")
    years = T.panel(spark, d).groupBy("fips").agg(F.count(F.lit(1)).alias("n_years")).withColumn("source", F.lit("EXAMPLE"))
    return facts.join(years, "source")


_BUNDLE_SQL = scoring.steps("scores", "census") + rounded_sql(
    """SELECT 'scores' AS part, count(*) AS n, sum(index_score) AS total, min(fips) AS first FROM scores
    UNION ALL SELECT 'components', count(DISTINCT fips), sum(score), min(fips) FROM comp_scores
    UNION ALL SELECT 'accelerations', count(*), sum(acceleration), min(fips) FROM accel
    UNION ALL SELECT 'correlation', count(*), sum(r), min(a) FROM pairs
    UNION ALL SELECT 'penalties', count(*), sum(penalty), min(component) FROM penalties
    UNION ALL SELECT 'k', 1, (SELECT k FROM kval), NULL
    UNION ALL SELECT 'universe_size', (SELECT count(*) FROM universe), (SELECT count(*) FROM universe), NULL
    UNION ALL SELECT 'n_penalties', (SELECT count(*) FROM penalties), (SELECT count(*) FROM penalties), NULL""",
    "total:4",
)


@query("write_score_bundle", _BUNDLE_SQL)
def write_score_bundle(spark, d):
    """An index result published twice; what a reader finds of the last one, by stored values."""
    result = I.compute_index(T.panel(spark, d), T.SETTINGS, T.census(spark, d))
    root = scratch_path(spark, "bundle")
    W.write_bundle({"scores": result.scores.limit(0)}, root)
    W.write_index(result, root)
    tables, facts = W.read_bundle(spark, root)
    wide = tables["components"]
    long = wide.unpivot(["scenario", "fips"], [c for c in P.COMPONENT_IDS if c in wide.columns], "component", "score")
    tables["components"] = long.where(F.col("score").isNotNull())
    measured = {
        "scores": (F.count(F.lit(1)), "index_score", "fips"), "components": (F.count_distinct("fips"), "score", "fips"),
        "accelerations": (F.count(F.lit(1)), "acceleration", "fips"), "correlation": (F.count(F.lit(1)), "r", "a"),
        "penalties": (F.count(F.lit(1)), "penalty", "component"),
    }
    rows = [
        tables[part].agg(n.alias("n"), F.sum(total).alias("total"), F.min(first).alias("first")).withColumn("part", F.lit(part))
        for part, (n, total, first) in measured.items()
    ]
    told = [("k", 1, facts["k"], None)] + [(f, int(facts[f]), facts[f], None) for f in ("universe_size", "n_penalties")]
    rows.append(spark.createDataFrame(told, "part string, n long, total double, first string"))
    return rounded(reduce(lambda a, b: a.unionByName(b), rows), "total:4")


@query(
    "write_harmonized",
    T.with_roles("panel") + "\nSELECT count(*) AS total_rows, count(DISTINCT fips) AS total_counties, min(year) AS first_year, max(year) AS last_year, '"
    + ",".join(P.COMPONENT_IDS) + "' AS components_included, '' AS components_missing FROM panel",
)
def write_harmonized(spark, d):
    path = W.write_panel(T.panel(spark, d), scratch_path(spark, "harmonized"), T.SCORING_YEAR)
    written = spark.read.json(f"{path}_metadata")
    return written.select(
        "total_rows", "total_counties", F.col("first_year").cast("int").alias("first_year"),
        F.col("last_year").cast("int").alias("last_year"), "components_included", "components_missing",
    )


@query(
    "write_validation_outputs",
    validating._EXTERNAL + rounded_sql(
        "SELECT indicator, pearson_r, status, (SELECT count(*) FROM external) AS n_rows, 'external' AS report FROM external", "pearson_r"
    ),
)
def write_validation_outputs(spark, d):
    """The report on external indicators, published with its metadata and read back."""
    external = V.external_validation(validating.scored(spark, d), T.panel(spark, d), T.census(spark, d), T.SCORING_YEAR)
    root = scratch_path(spark, "validation")
    counted = external.agg(F.count(F.lit(1)).alias("n_rows"))
    W.write_bundle({"validation_summary": external}, root, counted, report="external")
    tables, facts = W.read_bundle(spark, root)
    found = tables["validation_summary"].select("indicator", "pearson_r", "status")
    found = found.withColumn("n_rows", F.lit(int(facts["n_rows"])).cast("long")).withColumn("report", F.lit(facts["report"]))
    return rounded(found, "pearson_r")


# --- weather and storms ------------------------------------------------------------------

_ELEMENTS = "CASE event_type WHEN 'signup' THEN 'TMAX' WHEN 'click' THEN 'TMIN' WHEN 'purchase' THEN 'PRCP' ELSE 'SNOW' END"


@query(
    "scan_ghcn_csv",
    f"""WITH rows_ AS (SELECT concat('US', user_id) AS station_id, CAST(ts AS DATE) AS date, {_ELEMENTS} AS element,
        CASE WHEN value >= 100 THEN NULL ELSE floor(value * 10) / 10.0 END AS v, CASE WHEN value < 5 THEN 'X' ELSE '' END AS flag FROM events SEMI JOIN (SELECT s_suppkey AS user_id FROM supplier) USING (user_id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY station_id, date, element ORDER BY flag, v IS NULL, v) AS place FROM rows_ WHERE element <> 'SNOW')
    SELECT station_id, date, max(v) FILTER (WHERE element = 'TMAX') AS tmax, max(v) FILTER (WHERE element = 'TMIN') AS tmin, max(v) FILTER (WHERE element = 'PRCP') AS prcp,
    coalesce(max(flag) FILTER (WHERE element = 'TMAX'), '') AS q_flag_tmax, coalesce(max(flag) FILTER (WHERE element = 'TMIN'), '') AS q_flag_tmin, coalesce(max(flag) FILTER (WHERE element = 'PRCP'), '') AS q_flag_prcp
    FROM best WHERE place = 1 GROUP BY ALL""",
)
def scan_ghcn_csv(spark, d):
    kind = F.col("event_type")
    element = F.when(kind == "signup", "TMAX").when(kind == "click", "TMIN").when(kind == "purchase", "PRCP").otherwise("SNOW")
    blank = F.lit(None).cast("string")
    raw = T.table(spark, d, "events").select(
        F.concat(F.lit("US"), text(F.col("user_id"))), F.date_format("ts", "yyyyMMdd"), element,
        text(F.when(F.col("value") >= 100, F.lit(-9999)).otherwise(F.floor(F.col("value") * 10))),
        blank.alias("m"), F.when(F.col("value") < 5, F.lit("X")).alias("q"), blank.alias("s"), blank.alias("t"),
    )
    path = as_csv(raw, "ghcn", header=False, compression="gzip")
    stations = T.table(spark, d, "supplier").select(F.concat(F.lit("US"), text(F.col("s_suppkey"))).alias("station_id"))
    return R.ghcn_daily(spark, path, stations)


@query(
    "scan_fixed_width",
    """SELECT concat(CASE WHEN s_nationkey < 12 THEN 'US' ELSE 'CA' END, printf('%09d', s_suppkey)) AS station_id, round(s_acctbal / 1000.0, 5) + 0.0 AS lat,
    CAST(-s_nationkey AS DOUBLE) + 0.0 AS lon, CASE WHEN s_nationkey = 3 THEN NULL ELSE CAST(s_nationkey AS DOUBLE) END AS elevation, CASE WHEN s_nationkey < 20 THEN 'TX' ELSE '' END AS state, s_name AS name FROM supplier WHERE s_nationkey < 20""",
)
def scan_fixed_width(spark, d):
    n = F.col("s_nationkey")
    line = F.concat(
        F.when(n < 12, "US").otherwise("CA"), F.format_string("%09d ", F.col("s_suppkey")),
        F.format_string("%8.5f ", F.col("s_acctbal") / 1000.0), F.format_string("%9.4f ", -n.cast("double")),
        F.when(n == 3, F.lit("     x ")).otherwise(F.format_string("%6.1f ", n.cast("double"))),
        F.when(n < 20, "TX ").otherwise("   "), F.rpad("s_name", 30, " "),
    )
    path = as_text(T.table(spark, d, "supplier").select(line.alias("value")), "stations")
    return R.ghcn_stations(spark, path).withColumns({"lat": F.round("lat", 5) + 0.0, "lon": F.col("lon") + 0.0})


@query(
    "scan_normals_csv",
    T.with_roles("normals") + rounded_sql("SELECT station_id, month, (normal_tmax * 2 + 20 - 32) * 5 / 9 AS normal_tmax, (normal_tmin * 2 + 20 - 32) * 5 / 9 AS normal_tmin FROM normals", "normal_tmax:4 normal_tmin:4"),
)
def scan_normals_csv(spark, d):
    fahrenheit = lambda c: text(F.col(c) * 2.0 + 20.0)
    raw = T.normals(spark, d).select(
        F.col("station_id").alias("STATION"), F.format_string("%02d", F.col("month")).alias("month"),
        fahrenheit("normal_tmax").alias("MLY-TMAX-NORMAL"), fahrenheit("normal_tmin").alias("MLY-TMIN-NORMAL"),
    )
    return rounded(R.monthly_normals(spark, as_csv(raw, "normals")), "normal_tmax:4 normal_tmin:4")


def raw_details(spark, d) -> DataFrame:
    return T.table(spark, d, "orders").select(
        text(F.col("o_orderkey")).alias("EVENT_ID"), F.lit("5").alias("STATE_FIPS"), F.col("o_orderstatus").alias("CZ_TYPE"),
        text(F.col("o_custkey")).alias("CZ_FIPS"), F.date_format("o_orderdate", "yyyyMM").alias("BEGIN_YEARMONTH"),
        text(F.dayofmonth("o_orderdate")).alias("BEGIN_DAY"), F.col("o_orderpriority").alias("EVENT_TYPE"),
        F.concat(text(F.floor("o_totalprice")), F.lit("K")).alias("DAMAGE_PROPERTY"), F.lit("0").alias("DAMAGE_CROPS"),
        F.lit("1").alias("INJURIES_DIRECT"), F.lit("0").alias("DEATHS_DIRECT"), F.lit("9.5").alias("MAGNITUDE"),
        F.lit("unused, with a comma").alias("NARRATIVE"),
    )


@query(
    "scan_storm_csv",
    """SELECT CAST(o_orderkey AS VARCHAR) AS "EVENT_ID", CAST(o_custkey AS VARCHAR) AS "CZ_FIPS", o_orderpriority AS "EVENT_TYPE", concat(CAST(floor(o_totalprice) AS BIGINT), 'K') AS "DAMAGE_PROPERTY", lat AS "LATITUDE", lon AS "LONGITUDE"
    FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS lat, arg_min(l_linenumber, l_quantity * 100 + l_linenumber)::DOUBLE AS lon FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def scan_storm_csv(spark, d):
    details = R.storm_details(spark, as_csv(raw_details(spark, d), "details"))
    rows = T.table(spark, d, "lineitem").select(
        text(F.col("l_orderkey")).alias("EVENT_ID"), F.lit("x").alias("LOCATION"), text(F.col("l_quantity")).alias("LATITUDE"),
        text(F.col("l_linenumber")).alias("LONGITUDE"),
    )
    located = R.storm_locations(spark, as_csv(rows, "locations"))
    return details.join(located, "EVENT_ID", "left").select("EVENT_ID", "CZ_FIPS", "EVENT_TYPE", "DAMAGE_PROPERTY", "LATITUDE", "LONGITUDE")


@query(
    "scan_aqs_csv",
    """SELECT printf('%02d-%03d-%04d-1', user_id % 7 + 1, user_id, event_id) AS monitor_id, printf('%02d%03d', user_id % 7 + 1, user_id) AS fips, CAST(ts AS DATE) AS date,
    value AS pm25_value, CASE WHEN event_type = 'error' THEN NULL ELSE floor(value) END AS aqi_value, 38.5::DOUBLE AS lat, -90.25::DOUBLE AS lon FROM events""",
)
def scan_aqs_csv(spark, d):
    e = T.table(spark, d, "events")
    raw = e.select(
        text(F.col("user_id") % 7 + 1).alias("State Code"), text(F.col("user_id")).alias("County Code"), text(F.col("event_id")).alias("Site Num"),
        F.lit("1").alias("POC"), F.date_format("ts", "yyyy-MM-dd").alias("Date Local"), text(F.col("value")).alias("Arithmetic Mean"),
        F.when(F.col("event_type") != "error", text(F.floor("value"))).alias("AQI"), F.lit("38.5").alias("Latitude"), F.lit("-90.25").alias("Longitude"),
    )
    return R.aqs_daily(spark, as_csv(raw, "aqs"))


@query(
    "monitors_of_readings",
    """SELECT CAST(user_id AS VARCHAR) AS monitor_id, min(value) AS lat, 1.0::DOUBLE AS lon, printf('%05d', user_id) AS county_fips, substr(printf('%05d', user_id), 1, 2) AS state FROM events GROUP BY user_id""",
)
def monitors_of_readings(spark, d):
    rows = T.table(spark, d, "events").select(
        text(F.col("user_id")).alias("monitor_id"), F.col("value").alias("lat"), F.lit(1.0).alias("lon"),
        F.format_string("%05d", F.col("user_id")).alias("fips"),
    )
    return R.monitors_of(rows)


_DIV = "CASE n_regionkey WHEN 0 THEN 'Mountain North' WHEN 1 THEN 'Mountain South' WHEN 2 THEN 'Pacific' WHEN 3 THEN 'Nowhere' ELSE '4' END"


@query(
    "scan_recs_csv",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS household_id, CAST(CASE n_regionkey WHEN 0 THEN 8 WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 0 ELSE 4 END AS INTEGER) AS census_division,
    CASE n_regionkey WHEN 4 THEN 'West North Central' ELSE {_DIV} END AS census_division_name,
    CASE c_nationkey % 6 + 1 WHEN 1 THEN 'Mobile home' WHEN 2 THEN 'Single-family detached' WHEN 3 THEN 'Single-family attached' WHEN 4 THEN 'Apartment in 2-4 unit building' WHEN 5 THEN 'Apartment in 5+ unit building' ELSE 'Unknown' END AS dwelling_type,
    CASE c_nationkey % 3 WHEN 0 THEN 'Not applicable' WHEN 1 THEN 'Electricity' ELSE 'Unknown' END AS heating_fuel,
    c_acctbal AS square_footage, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS annual_electricity_kwh, CAST(NULL AS DOUBLE) AS annual_gas_ccf, CAST(2020 AS INTEGER) AS recs_year
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def scan_recs_csv(spark, d):
    n = F.col("c_nationkey")
    region = F.col("n_regionkey")
    division = F.when(region == 0, "Mountain North").when(region == 1, "Mountain South").when(region == 2, "Pacific").when(region == 3, "Nowhere").otherwise("4")
    raw = T.table(spark, d, "customer").join(T.table(spark, d, "nation"), n == F.col("n_nationkey")).select(
        text(F.col("c_custkey")).alias("doeid"), division.alias("Division"), text(n % 6 + 1).alias("typehuq"),
        text(F.col("c_acctbal")).alias("TOTSQFT_EN"),
        F.when(n % 3 == 0, "-2").when(n % 3 == 1, "5").otherwise("99").alias("FUELHEAT"), F.lit("3").alias("NHSLDMEM"),
        text(F.col("c_acctbal")).alias("KWH"), F.lit("none").alias("CUFEETNG"), F.lit("1.5").alias("NWEIGHT"),
    )
    return R.recs_households(spark, as_csv(raw, "recs")).select(
        "household_id", "census_division", "census_division_name", "dwelling_type", "heating_fuel", "square_footage",
        "annual_electricity_kwh", "annual_gas_ccf", "recs_year",
    )


# --- JSON ----------------------------------------------------------------------------------


def array_document(rows: DataFrame, header: list[str], group) -> DataFrame:
    """One JSON document per group: an array of text arrays whose first row is the header."""
    cells = F.array(*[F.col(c) for c in rows.columns])
    documents = rows.withColumn("_group", group).groupBy("_group").agg(F.collect_list(cells).alias("rows"))
    return documents.select(F.to_json(F.concat(F.array(F.array(*[F.lit(h) for h in header])), F.col("rows"))).alias("value"))


@query(
    "scan_acs_json",
    """SELECT printf('%02d%03d', s_nationkey + 1, s_suppkey) AS fips, CAST(2019 AS INTEGER) AS year, CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_suppkey AS DOUBLE) END AS total_housing_units,
    CAST(NULL AS DOUBLE) AS owner_occupied_units, s_acctbal AS population, 50.5::DOUBLE AS median_household_income FROM supplier""",
)
def scan_acs_json(spark, d):
    s = T.table(spark, d, "supplier")
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    rows = s.select(
        text(F.col("s_acctbal")).alias("p"), F.when(F.col("s_acctbal") < 0, "-666666666").otherwise(text(k)).alias("h"),
        F.lit("null").alias("o"), F.lit("50.5").alias("i"), text(n + 1).alias("s"), text(k).alias("c"),
    )
    header = ["B01003_001E", "B25001_001E", "B25003_002E", "B19013_001E", "state", "county"]
    # One document per state and thousand counties, each on its own line.
    documents = array_document(rows, header, F.concat_ws("-", F.col("s"), F.floor(F.col("c").cast("long") / 1000)))
    return R.acs_counties(spark, as_text(documents, "acs"), 2019, lines=True)


@query(
    "scan_block_groups_json",
    """SELECT printf('%02d%03d%06d%s', s_nationkey + 1, s_nationkey, s_suppkey, '3') AS block_group_fips, printf('%02d%03d', s_nationkey + 1, s_nationkey) AS county_fips,
    printf('%02d', s_nationkey + 1) AS state_fips, s_acctbal AS housing_units FROM supplier""",
)
def scan_block_groups_json(spark, d):
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    rows = T.table(spark, d, "supplier").select(
        text(F.col("s_acctbal")).alias("h"), text(n + 1).alias("s"), text(n).alias("c"), text(k).alias("t"), F.lit("3").alias("g")
    )
    header = ["B25001_001E", "state", "county", "tract", "block group"]
    documents = array_document(rows, header, F.concat_ws("-", F.col("s"), F.floor(F.col("t").cast("long") / 1000)))
    return R.acs_block_groups(spark, as_text(documents, "blocks"), lines=True)


@query(
    "scan_json_records",
    """SELECT printf('%05d', o_custkey) AS fips, CAST(o_orderdate AS DATE) AS date, o_totalprice AS d0_pct, 1.5::DOUBLE AS d1_pct, 0.0::DOUBLE AS d2_pct, CAST(NULL AS DOUBLE) AS d3_pct, 0.0::DOUBLE AS d4_pct, 98.5::DOUBLE AS none_pct FROM orders""",
)
def scan_json_records(spark, d):
    raw = T.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("mapDate"), text(F.col("o_custkey")).alias("fips"),
        F.col("o_totalprice").alias("d0"), F.lit(1.5).alias("d1"), F.lit("0.0").alias("d2"), F.lit("n/a").alias("d3"), F.lit(0).alias("d4"),
        F.lit(98.5).alias("none"),
    )
    return R.drought_weeks(spark, as_json(raw, "drought"))


@query(
    "scan_declarations_json",
    """SELECT CAST(o_orderkey AS VARCHAR) AS disaster_number, CASE WHEN o_orderstatus <> 'P' THEN printf('%02d%03d', c_nationkey + 1, 9) END AS fips, CAST(year(o_orderdate) AS INTEGER) AS year,
    CAST(NULL AS DOUBLE) AS ia_amount, CAST(NULL AS DOUBLE) AS registrant_count, CASE WHEN o_orderstatus = 'F' THEN 'Unknown' ELSE o_orderpriority END AS disaster_type, CAST(o_orderdate AS DATE) AS declaration_date
    FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def scan_declarations_json(spark, d):
    raw = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("disasterNumber"), F.format_string("%02d", F.col("c_nationkey") + 1).alias("fipsStateCode"),
        F.when(F.col("o_orderstatus") == "P", "000").otherwise("009").alias("fipsCountyCode"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("declarationDate"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("incidentType"),
    )
    return R.declarations(spark, as_json(raw, "declarations"))


@query(
    "payout_ingest_agg",
    """SELECT CAST(o_custkey AS VARCHAR) AS disaster_number, 'TX' AS state, o_orderpriority AS county, round(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END), 2) + 0.0 AS ia_amount,
    CAST(count(*) AS DOUBLE) * 2 AS registrant_count FROM orders GROUP BY ALL""",
)
def payout_ingest_agg(spark, d):
    def page(where):
        rows = T.table(spark, d, "orders").where(where).select(
            F.col("o_custkey").alias("disasterNumber"), F.lit("TX").alias("state"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("county"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("totalApprovedIhpAmount"), F.lit(2).alias("validRegistrations"),
        )
        return as_json(rows, "assistance")

    owner = F.col("o_totalprice") > 200000
    return rounded(R.assistance(spark, page(owner), page(~owner)), "ia_amount:2")


@query(
    "scan_health_json",
    """SELECT printf('%05d', o_custkey) AS fips, substr(printf('%05d', o_custkey), 1, 2) AS state_fips, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE WHEN o_orderstatus = 'P' OR o_totalprice < 1000 THEN NULL ELSE floor(o_totalprice) END AS heat_ed_visits, CAST(NULL AS DOUBLE) AS population, 'county' AS geo_resolution FROM orders""",
)
def scan_health_json(spark, d):
    raw = T.table(spark, d, "orders").select(
        text(F.year("o_orderdate")).alias("temporal"), text(F.col("o_custkey")).alias("geoId"),
        F.when(F.col("o_totalprice") < 1000, "*").otherwise(F.format_number(F.floor("o_totalprice"), 0)).alias("dataValue"),
        F.when(F.col("o_orderstatus") == "P", "1").otherwise("0").alias("suppressionFlag"),
    )
    return R.health_visits(spark, as_json(raw, "health"), "county")


@query(
    "scan_energy_json",
    f"""WITH st(code, abbr) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in P.STATE_ABBR.items())}),
    cell AS (SELECT abbr, code, CAST(year(o_orderdate) AS INTEGER) AS year, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders JOIN customer ON c_custkey = o_custkey JOIN st ON code = printf('%02d', c_nationkey + 1) GROUP BY ALL)
    SELECT code AS state_fips, abbr AS state_abbr, year, CASE WHEN year < 2001 THEN hi END AS electricity_price_cents_kwh, CASE WHEN year > 1995 THEN lo END AS electricity_consumption_mwh,
    CASE WHEN year = 1999 THEN hi END AS natural_gas_price FROM cell""",
)
def scan_energy_json(spark, d):
    cell = (
        T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.format_string("%02d", F.col("c_nationkey") + 1).alias("code"), F.year("o_orderdate").alias("year"))
        .agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
        .withColumn("abbr", F.lower(P.lookup(P.STATE_ABBR, F.col("code"), "US")))
    )
    period = text(F.col("year")).alias("period")
    prices = cell.where("year < 2001").select(F.col("abbr").alias("stateid"), period, F.col("hi").alias("price"))
    sales = cell.where("year > 1995").select(F.col("abbr").alias("stateid"), period, F.col("lo").alias("sales"))
    gas = cell.where("year = 1999").select(F.col("abbr").alias("duoarea"), period, text(F.col("hi")).alias("value"))
    return R.energy_states(spark, as_json(prices, "prices"), as_json(sales, "sales"), as_json(gas, "gas"))


@query(
    "scan_series_json",
    """WITH months AS (SELECT s_nationkey AS n, CAST(year(l_shipdate) AS INTEGER) AS year, month(l_shipdate) AS m, avg(l_quantity) AS v, max(l_extendedprice) AS top FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    yearly AS (SELECT n, year, CASE WHEN year = 1997 THEN max(top) ELSE avg(v) END AS food_cpi_index, CASE WHEN year = 1997 THEN 'M13' ELSE 'computed' END AS period_type FROM months GROUP BY n, year)"""
    + rounded_sql(
        """SELECT CASE n WHEN 0 THEN '0000' WHEN 1 THEN '0100' ELSE concat('A', n + 100) END AS area_code, CASE WHEN n < 5 THEN concat('Area ', n) ELSE concat('Unknown (A', n + 100, ')') END AS area_name,
        CASE n WHEN 0 THEN 'national' WHEN 1 THEN 'region' ELSE 'metro' END AS geo_type, year, food_cpi_index,
        (food_cpi_index - lag(food_cpi_index) OVER w) / lag(food_cpi_index) OVER w * 100 AS food_cpi_yoy_change, period_type FROM yearly WINDOW w AS (PARTITION BY n ORDER BY year)""",
        "food_cpi_index food_cpi_yoy_change",
    ),
)
def scan_series_json(spark, d):
    n = F.col("s_nationkey")
    area = F.when(n == 0, "0000").when(n == 1, "0100").otherwise(F.concat(F.lit("A"), text(n + 100)))
    monthly = (
        T.table(spark, d, "lineitem").join(T.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(n, F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("m"))
        .agg(F.avg("l_quantity").alias("v"), F.max("l_extendedprice").alias("top"))
    )
    point = lambda period, value: F.struct(text(F.col("year")).alias("year"), period.alias("period"), text(value).alias("value"))
    months = monthly.select(area.alias("area"), point(F.concat(F.lit("M"), F.lpad(text(F.col("m")), 2, "0")), F.col("v")).alias("p"))
    published = monthly.where("year = 1997").groupBy(n, "year").agg(F.max("top").alias("top")).select(
        area.alias("area"), point(F.lit("M13"), F.col("top")).alias("p")
    )
    series = months.unionByName(published).groupBy("area").agg(F.collect_list("p").alias("data")).select(
        F.concat(F.lit("CUUR"), "area", F.lit("SAF11")).alias("seriesID"), "data"
    )
    areas = T.table(spark, d, "nation").where("n_nationkey < 5").withColumnRenamed("n_nationkey", "s_nationkey").select(
        area.alias("area_code"), F.concat(F.lit("Area "), text(F.col("s_nationkey"))).alias("area_name")
    )
    return rounded(R.food_prices(spark, as_json(series, "series"), areas), "food_cpi_index food_cpi_yoy_change")


@query(
    "scan_tsv_areas",
    """SELECT concat('A', s_suppkey + 100) AS area_code, s_name AS area_name FROM supplier WHERE s_nationkey < 10
    UNION ALL SELECT concat('S', s_suppkey, 'B'), s_name FROM supplier WHERE s_nationkey BETWEEN 10 AND 14 AND length(concat('S', s_suppkey, 'B')) >= 3
    UNION ALL VALUES ('0000', 'U.S. city average'), ('0100', 'Northeast'), ('0200', 'Midwest'), ('0300', 'South'), ('0400', 'West')""",
)
def scan_tsv_areas(spark, d):
    n, k = F.col("s_nationkey"), text(F.col("s_suppkey"))
    code = F.when(n < 10, F.concat(F.lit("A"), text(F.col("s_suppkey") + 100))).when(n < 15, F.concat(F.lit("S"), k, F.lit("B"))).otherwise(F.concat(F.lit("D"), k))
    rows = T.table(spark, d, "supplier").select(F.concat_ws("\t", code, "s_name", F.lit("0"), F.lit("T"), k).alias("value"))
    header = spark.createDataFrame([("area_code\tarea_name\tdisplay_level\tselectable\tsort_sequence",)], "value string")
    return R.price_areas(spark, as_text(header.unionByName(rows), "areas"))


@query(
    "scan_county_list",
    """SELECT printf('%02d', s_nationkey + 1) AS state_fips, printf('%03d', s_suppkey) AS county_fips_3, s_name AS county_name, 'H1' AS classfp, concat(printf('%02d', s_nationkey + 1), printf('%03d', s_suppkey)) AS fips5 FROM supplier""",
)
def scan_county_list(spark, d):
    n = F.col("s_nationkey")
    four = F.concat_ws(",", F.format_string("%02d", n + 1), F.format_string("%03d", F.col("s_suppkey")), "s_name", F.lit("H1"))
    line = F.when(n < 12, F.concat(F.lit("TX, "), four)).otherwise(four)
    return R.county_list(spark, as_text(T.table(spark, d, "supplier").select(line.alias("value")), "counties"))


@query("scan_county_names", "SELECT printf('%05d', s_suppkey) AS fips, printf('%02d', s_nationkey) AS state_fips, s_name AS name FROM supplier")
def scan_county_names(spark, d):
    rows = T.table(spark, d, "supplier").select(
        F.format_string("%05d", F.col("s_suppkey")).alias("fips"), F.format_string("%02d", F.col("s_nationkey")).alias("state_fips"),
        F.col("s_name").alias("name"),
    )
    return R.county_names(spark, as_csv(rows, "names"))


@query(
    "scan_geoparquet_layers",
    T.with_roles("boxes") + "\nSELECT fips, 1::BIGINT AS n_rings, 5::BIGINT AS n_points, round(west, 6) AS west, round(north, 6) AS north FROM boxes",
)
def scan_geoparquet_layers(spark, d):
    path = scratch_path(spark, "layer")
    T.boxes(spark, d).withColumnRenamed("fips", "GEOID").write.parquet(path)
    layer = R.polygon_layer(spark, path, {"GEOID": "fips"})
    box = G.bounds_of(F.col("rings"))
    return layer.select(
        "fips", F.size("rings").cast("long").alias("n_rings"), F.size(F.element_at("rings", 1)).cast("long").alias("n_points"),
        F.round(box["west"], 6).alias("west"), F.round(box["north"], 6).alias("north"),
    )


@query("scan_nri_benchmark", "SELECT printf('%05d', s_suppkey) AS fips, s_acctbal AS nri_score FROM supplier WHERE s_acctbal >= 0")
def scan_nri_benchmark(spark, d):
    raw = T.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("FIPS"), F.when(F.col("s_acctbal") >= 0, text(F.col("s_acctbal"))).otherwise("n/a").alias("RISK_VALUE")
    )
    return R.risk_benchmark(spark.read.option("header", True).csv(as_csv(raw, "nri")))


@query("scan_acs_latest_vintage", T.with_roles("census") + "\nSELECT fips, year, population FROM census WHERE year = (SELECT max(year) FROM census WHERE year BETWEEN 1999 AND 2003)")
def scan_acs_latest_vintage(spark, d):
    root = scratch_path(spark, "acs")
    W.write_year_partitions(T.census(spark, d), root, "census")
    return R.latest_vintage(R.parquet_years(spark, root, "census"), 2003).select("fips", "year", "population")


@query(
    "scan_expenditure_table",
    """WITH sheet AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey = 20 THEN 'Average annual expenditures' WHEN o_orderkey = (SELECT max(o_orderkey) - 30 FROM orders) THEN 'Income before taxes'
        ELSE concat('  Item, no. ', o_orderkey) END AS item, o_totalprice AS a, o_custkey AS b FROM orders),
    used AS (SELECT * FROM sheet WHERE line >= 20 AND line < (SELECT min(line) FROM sheet WHERE item LIKE 'Income before%')),
    cells AS (SELECT trim(item) AS category, a AS annual_expenditure, CAST(2022 AS INTEGER) AS year FROM used WHERE a >= 50000 UNION ALL SELECT trim(item), CAST(b AS DOUBLE), 2023 FROM used)"""
    + rounded_sql(
        """SELECT upper(trim(regexp_replace(category, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS item_code, category, annual_expenditure, annual_expenditure / total * 100 AS pct_of_total, year
        FROM cells JOIN (SELECT year, max(annual_expenditure) AS total FROM cells WHERE category = 'Average annual expenditures' GROUP BY year) USING (year)""",
        "pct_of_total",
    ),
)
def scan_expenditure_table(spark, d):
    key = F.col("o_orderkey")
    last = T.table(spark, d, "orders").agg((F.max("o_orderkey") - 30).alias("last"))
    orders = T.table(spark, d, "orders").join(last, key >= 0, "left")
    item = F.when(key == 20, "Average annual expenditures").when(key == F.col("last"), "Income before taxes").otherwise(
        F.concat(F.lit("  Item, no. "), text(key))
    )
    lines = orders.select(
        text(key).alias("line"), item.alias("Item"),
        F.when(F.col("o_totalprice") < 50000, "b/").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2), F.lit(" (1)"))).alias("2022"),
        text(F.col("o_custkey")).alias("2023"),
    )
    path = as_csv(lines, "sheet", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    sheet = spark.read.option("header", True).csv(path).withColumn("line", F.col("line").cast("long"))
    return rounded(R.expenditure_table(sheet, {"2022": 2022, "2023": 2023}, "Item", "line"), "pct_of_total")
