"""Station files: registry and portal CSV, and the fixed stations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.functions import text as x


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return spark.read.csv(
        path, header=True, multiLine=multi_line, escape='"', encoding="UTF-8", mode="PERMISSIVE"
    )


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def load_registry(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """Registry rows of several CSV files, earlier files first.

    `seq` orders rows as they were listed: file, part file, offset of the split, line in the split.
    Rows whose coordinates are not numbers, or are missing, are left out. Large files are split between
    tasks; `multi_line=True` reads each in one, which fields with line breaks need.
    """
    files = []
    for rank, path in enumerate(paths):
        csv = _read_csv(spark, path, multi_line)
        state = F.translate(_field(csv, "state"), "_", " ")
        files.append(
            csv.select(
                F.struct(
                    F.lit(rank).alias("file"),
                    F.col("_metadata.file_path").alias("part"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"),
                ).alias("seq"),
                F.coalesce(x.strip(_field(csv, "station")), F.lit("")).alias("full_name"),
                x.strip(state).alias("state"),
                x.strip(_field(csv, "city")).alias("city"),
                x.to_number(_field(csv, "latitude")).alias("latitude"),
                x.to_number(_field(csv, "longitude")).alias("longitude"),
            )
        )
    rows = reduce(DataFrame.unionByName, files)
    return rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "seq", "full_name", x.name_key(F.col("full_name")).alias("norm"), "state", "city", "latitude", "longitude"
    )


def load_portal(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Portal rows keyed by public id, under the same tolerance."""
    csv = _read_csv(spark, path, multi_line)
    rows = csv.select(
        F.coalesce(x.strip(_field(csv, "station_id")), F.lit("")).alias("station_id"),
        x.strip(_field(csv, "station_name")).alias("station_name"),
        x.strip(_field(csv, "state")).alias("state"),
        x.strip(_field(csv, "city")).alias("city"),
        x.to_number(_field(csv, "latitude")).alias("latitude"),
        x.to_number(_field(csv, "longitude")).alias("longitude"),
    )
    return rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


PLACE_COLUMNS = "station_id string, station_name string, city string, state string, latitude double, longitude double"


def fixed_stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.FIXED_STATIONS, PLACE_COLUMNS)


def no_places(spark: SparkSession) -> DataFrame:
    """Stands for a portal file that does not exist."""
    return spark.createDataFrame([], PLACE_COLUMNS)
