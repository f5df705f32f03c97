"""The published tree: `v1/measurements/year=YYYY/month=MM/run=…/`, read whole or by month, and always by
the folders that its manifest names, one for a month."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourmark import schema as S
from hourmark.functions import time as t


def version_root(root: str) -> str:
    return f"{root.rstrip('/')}/{S.SCHEMA_VERSION}"


def measurements_path(root: str) -> str:
    return f"{version_root(root)}/measurements"


def month_key(year: int, month: int) -> str:
    return f"{S.SCHEMA_VERSION}/measurements/year={year}/month={month:02d}"


def load_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest as the one JSON object it is: an entry per month, whose `folder` holds its files.

    Folders that a publish has begun to write, or has replaced and not deleted yet, are not in it.
    """
    handle, files = file_system(spark, manifest_path(root))
    return json.loads(read_text(spark, manifest_path(root))) if files.exists(handle) else None


def read_text(spark: SparkSession, path: str) -> str:
    handle, files = file_system(spark, path)
    stream = files.open(handle)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def month_entries(manifest: dict | None) -> list[dict]:
    return manifest["measurements"]["months"] if manifest else []


def read_folders(spark: SparkSession, root: str, folders: list[str], schema: T.StructType | None = None, base: str = "") -> DataFrame:
    """The files under some folders of the tree, a path for each. `schema` gives the columns and their types;
    with `base`, partition columns below that folder are among the columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    reader = reader.option("basePath", f"{root.rstrip('/')}/{base}") if base else reader
    found = reader.parquet(*[f"{root.rstrip('/')}/{folder}" for folder in folders])
    return found if schema is None else found.select(*schema.fieldNames())


def scan_tree(spark: SparkSession, root: str, wanted: Callable[[dict], bool] = lambda _: True) -> DataFrame:
    """The months of the manifest, or those whose entry is wanted: one path each, no list of files."""
    folders = [m["folder"] for m in month_entries(load_manifest(spark, root)) if wanted(m)]
    return read_folders(spark, root, folders, S.FACT, f"{S.SCHEMA_VERSION}/measurements") if folders else empty_fact(spark)


def empty_fact(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.FACT)


def months_between(first: date, last: date) -> Column:
    """Partition predicate for the months that hold days `first` through `last`."""
    year, month = F.col("year"), F.col("month")
    if first.year == last.year:
        return (year == first.year) & month.between(first.month, last.month)
    return (
        ((year == first.year) & (month >= first.month))
        | ((year > first.year) & (year < last.year))
        | ((year == last.year) & (month <= last.month))
    )


def in_window(first: date, last: date) -> Callable[[dict], bool]:
    """Whether the month of an entry holds any of the days `first` through `last`."""
    return lambda m: (first.year, first.month) <= (m["year"], m["month"]) <= (last.year, last.month)


def scan_months(spark: SparkSession, root: str, first: date, last: date) -> DataFrame:
    """Only the months that hold days `first` through `last`; none of them may be published."""
    return scan_tree(spark, root, in_window(first, last))


def scan_days(spark: SparkSession, root: str, first: date, last: date) -> DataFrame:
    """Readings of days `first` through `last`: months by partition, days by pushed-down filter."""
    after = last + timedelta(days=1)
    return scan_months(spark, root, first, last).where(t.within(F.col("collected_at"), first, after))


def month_keys(spark: SparkSession, year: int, first_month: int, last_month: int) -> DataFrame:
    """Generated keys of a run of months, one `key` per row."""
    keys = F.transform(
        F.sequence(F.lit(first_month), F.lit(last_month)),
        lambda m: F.format_string(S.SCHEMA_VERSION + "/measurements/year=%d/month=%02d", F.lit(year), m),
    )
    return spark.range(1).select(F.explode(keys).alias("key"))


def scan_keys(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """Exactly the months named by their keys."""
    return scan_tree(spark, root, lambda m: m["key"] in set(keys))


def visible_years(df: DataFrame, years: list[int]) -> DataFrame:
    """The readings a caller limited to some years may scan."""
    return df.where(F.col("year").isin([int(y) for y in years]))


def stations_path(root: str) -> str:
    return f"{version_root(root)}/stations.parquet"


def parameters_path(root: str) -> str:
    return f"{version_root(root)}/parameters.parquet"


def series_path(root: str) -> str:
    """Per-month summary of every series."""
    return f"{version_root(root)}/series"


def series_years_path(root: str) -> str:
    """The same by year, from which the two dimension tables are made."""
    return f"{version_root(root)}/series_years"


def manifest_path(root: str) -> str:
    """One object, replaced as a whole."""
    return f"{version_root(root)}/_manifest.json"


def file_system(spark: SparkSession, path: str):
    """A path and its file system, wherever the tree is kept."""
    context = spark.sparkContext
    if _hadoop.get("app") != context.applicationId:  # looking a class up takes several calls
        _hadoop.update(app=context.applicationId, path=spark._jvm.org.apache.hadoop.fs.Path, conf=spark._jsc.hadoopConfiguration())
    handle = _hadoop["path"](path)
    return handle, handle.getFileSystem(_hadoop["conf"])


_hadoop: dict = {}


def read_stations(spark: SparkSession, root: str) -> DataFrame:
    return _read_table(spark, root, "stations")


def read_parameters(spark: SparkSession, root: str) -> DataFrame:
    return _read_table(spark, root, "parameters")


def _read_table(spark: SparkSession, root: str, kind: str) -> DataFrame:
    manifest = load_manifest(spark, root)
    if manifest is None:
        raise ValueError(f"nothing has been published under {root}")
    return read_folders(spark, root, [manifest[kind]["folder"]])


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest as one row; none where nothing has been published."""
    manifest = load_manifest(spark, root)
    texts = [] if manifest is None else [(json.dumps(manifest),)]
    return spark.createDataFrame(texts, "text string").select(F.from_json("text", S.MANIFEST).alias("m")).select("m.*")


def manifest_months(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.inline("measurements.months"))


def window_series(spark: SparkSession, root: str, first: date, last: date) -> DataFrame:
    """Station, state, city and network names of the series in the months of a window, as they were published."""
    folders = [m["series"] for m in month_entries(load_manifest(spark, root)) if in_window(first, last)(m)]
    return read_folders(spark, root, folders) if folders else spark.createDataFrame([], S.SERIES)


def matching_stations(series: DataFrame, names: Column) -> DataFrame:
    """Ids of the stations that a condition on their names, state, city or network holds for under any
    name that they have in `window_series`."""
    return series.where(names).select("station_id").distinct()
