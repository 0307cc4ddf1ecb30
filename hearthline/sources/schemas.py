"""Column contracts of the raw tables."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "date": DateType()}


def _schema(columns: str) -> StructType:
    """Struct of ``name type`` pairs; needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


DAILY_OBS = _schema(
    "station_id string, date date, tmax double, tmin double, prcp double, "
    "q_flag_tmax string, q_flag_tmin string, q_flag_prcp string"
)
STATIONS = _schema("station_id string, lat double, lon double, elevation double, state string, name string")
STORM_EVENTS = _schema(
    "event_id string, fips string, date date, event_type string, property_damage double, crop_damage double, "
    "injuries_direct double, deaths_direct double, magnitude double, begin_lat double, begin_lon double"
)
READINGS = _schema(
    "monitor_id string, fips string, date date, pm25_value double, aqi_value double, lat double, lon double"
)
WEEKLY_DROUGHT = _schema(
    "fips string, date date, d0_pct double, d1_pct double, d2_pct double, d3_pct double, d4_pct double, none_pct double"
)
DECLARATIONS = _schema(
    "disaster_number string, fips string, year int, ia_amount double, registrant_count double, "
    "disaster_type string, declaration_date date"
)
PAYOUTS = _schema("disaster_number string, state string, county string, ia_amount double, registrant_count double")
CENSUS = _schema(
    "fips string, year int, total_housing_units double, owner_occupied_units double, population double, "
    "median_household_income double"
)
BLOCK_GROUPS = _schema("block_group_fips string, county_fips string, state_fips string, housing_units double")
ED_VISITS = _schema(
    "fips string, state_fips string, year int, heat_ed_visits double, population double, geo_resolution string"
)
ENERGY = _schema(
    "state_fips string, state_abbr string, year int, electricity_price_cents_kwh double, "
    "electricity_consumption_mwh double, natural_gas_price double"
)
HOUSEHOLDS = _schema(
    "household_id string, census_division int, census_division_name string, dwelling_type string, "
    "dwelling_type_code int, square_footage double, heating_fuel string, heating_fuel_code int, num_occupants int, "
    "annual_electricity_kwh double, annual_gas_ccf double, sample_weight double, recs_year int"
)
FOOD_PRICES = _schema(
    "area_code string, area_name string, geo_type string, year int, food_cpi_index double, "
    "food_cpi_yoy_change double, period_type string"
)
EXPENDITURE = _schema(
    "item_code string, category string, annual_expenditure double, pct_of_total double, year int"
)
