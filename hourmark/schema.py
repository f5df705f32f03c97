"""Schemas and fixed values of the published data set."""

from __future__ import annotations

from pyspark.sql import types as T

# Every name, pattern, number and row below must stay as it is for results to match.

SCHEMA_VERSION = "v1"
ROW_GROUP_ROWS = 1_000_000
TIMEZONE_NOTE = "collected_at is a naive timestamp in Indian Standard Time (UTC+05:30)."
ANSWER_TIMEZONE = "IST (UTC+05:30), naive timestamps"

MAIN_NETWORK = "cpcb_caaqm"
FIXED_NETWORK = "us_embassy"
FIXED_ID_PREFIX = "DS101"

FIXED_STATIONS = [  # station_id, station_name, city, state, latitude, longitude
    ("DS1010001", "US Embassy - New Delhi", "New Delhi", "Delhi", 28.635760, 77.224450),
    ("DS1010002", "US Embassy - Chennai", "Chennai", "Tamil Nadu", 13.087840, 80.278475),
    ("DS1010003", "US Embassy - Kolkata", "Kolkata", "West Bengal", 22.562630, 88.363040),
    ("DS1010004", "US Embassy - Mumbai", "Mumbai", "Maharashtra", 19.072830, 72.882610),
    ("DS1010005", "US Embassy - Hyderabad", "Hyderabad", "Telangana", 17.384050, 78.456360),
]

UNIT_SPELLINGS = {"UG/M3": "µg/m³", "MG/M3": "mg/m³"}

SITE_PREFIX = r"^site_[0-9]+_"
SITE_ID = r"^(site_[0-9]+)_"
AGENCY_SUFFIX = r" - [^-]*\z"
NOT_KEY_CHARACTER = r"[^a-z0-9]"

EARTH_RADIUS_KM = 6371
MOVED_KM = 1

DEFAULT_WINDOW_DAYS = 30
TIER_MAX_ROWS = {
    "full": None,
    "admin": None,
    "research": 5_000_000,
    "free": 100_000,
    "dashboard": 100_000,
    "demo": 10_000,
}
DEFAULT_TIER = "free"
JSON_MAX_ROWS = 200_000
CUT_HINT = (
    "Result was cut at max_rows. Narrow the query, aggregate, use csv/parquet, or download the bulk files at /v1/files."
)
STATIONS_CAP = 100_000
PARAMETERS_CAP = 10_000

TIER_REQUESTS_PER_MINUTE = {"free": 60, "research": 600, "dashboard": 120, "demo": 300}
UNLIMITED_TIERS = ["full", "admin"]
USAGE_REPORT_CAP = 500
KEYS_LISTING_CAP = 500
USERS_LISTING_CAP = 1000
DEMO_OWNER = "(demo key)"
DEMO_TIER = "demo"

COLUMN_NOTES = {
    "station_id": "VARCHAR",
    "station_name": "VARCHAR",
    "state_name": "VARCHAR",
    "city_name": "VARCHAR",
    "parameter_name": "VARCHAR",
    "unit": "VARCHAR",
    "collected_at": "TIMESTAMP",
    "value": "DOUBLE",
    "source": "VARCHAR ('cpcb_caaqm' | 'us_embassy')",
    "year": "hive partition",
    "month": "hive partition",
}

# End of fixed values.

FACT_BODY = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("station_name", T.StringType()),
        T.StructField("state_name", T.StringType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("parameter_name", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("collected_at", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
FACT = T.StructType(
    FACT_BODY.fields
    + [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
)
FACT_COLUMNS = FACT_BODY.fieldNames()

# The key of one published series, with the descriptive columns it was published under.
SERIES_KEY = [
    "station_id",
    "parameter_name",
    "unit",
    "station_name",
    "state_name",
    "city_name",
    "source",
]
SERIES = T.StructType([T.StructField(c, T.StringType()) for c in SERIES_KEY])
SORT_KEY = ["station_id", "parameter_name", "collected_at"]

_MONTH_ENTRY = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("files", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("folder", T.StringType()),  # where the files of the month are: of the run that wrote it
        T.StructField("series", T.StringType()),  # where its series summary is
    ]
)
_YEAR_ENTRY = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("folder", T.StringType()),
    ]
)
_TABLE_ENTRY = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("ids", T.LongType()),  # stations, where the table may list one more than once
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("exported_at", T.StringType()),
        T.StructField("timezone_note", T.StringType()),
        T.StructField("columns", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "measurements",
            T.StructType(
                [
                    T.StructField("rows", T.LongType()),
                    T.StructField("bytes", T.LongType()),
                    T.StructField("months", T.ArrayType(_MONTH_ENTRY)),
                ]
            ),
        ),
        T.StructField("stations", _TABLE_ENTRY),
        T.StructField("parameters", _TABLE_ENTRY),
        T.StructField("series_years", T.ArrayType(_YEAR_ENTRY)),
        T.StructField("batches", T.MapType(T.StringType(), T.LongType())),  # the last batch of each stream
    ]
)
