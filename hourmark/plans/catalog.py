"""The manifest of a published tree and the listings made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.sources import tree


def file_sizes(scan: DataFrame, root: str, kind: str) -> DataFrame:
    """The files of a scan, a row each. Reads footers only: no data column is needed."""
    by = [F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")] if "year" in scan.columns else []
    path = F.col("_metadata.file_path").alias("path")
    files = scan.groupBy(*by, path).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    # the key is cut out of the path once per file, not once per row
    key = F.concat(F.lit(f"{S.SCHEMA_VERSION}/"), F.regexp_extract(F.url_decode("path"), rf"^.*/{S.SCHEMA_VERSION}/([^:]*)\z", 1))
    sizes = files.groupBy(*[c for c in ("year", "month") if by], key.alias("key")).agg(F.sum("rows").alias("rows"), F.max("bytes").alias("bytes"))
    none = F.lit(None).cast("int")
    return sizes.select(
        F.lit(kind).alias("kind"), "key", *(["year", "month"] if by else [none.alias("year"), none.alias("month")]), "rows", "bytes"
    )


def month_sizes(files: DataFrame) -> DataFrame:
    """Rows, bytes and files of every month, from its files. `key` is the month's folder."""
    key = F.format_string(S.SCHEMA_VERSION + "/measurements/year=%d/month=%02d", F.col("year"), F.col("month"))
    return (
        files.where("kind = 'measurements'")
        .groupBy("year", "month")
        .agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
        .select("year", "month", "rows", "bytes", "files", key.alias("key"))
    )


def coverage_summary(manifest_row: DataFrame) -> DataFrame:
    """Totals of a manifest: rows, bytes, months, first and last month, stations, parameters."""
    months = F.col("measurements.months")
    size = F.size(months)

    def label(entry):
        return F.format_string("%d-%02d", entry["year"], entry["month"])

    return manifest_row.select(
        F.col("measurements.rows").alias("rows"),
        F.col("measurements.bytes").alias("bytes"),
        size.alias("n_months"),
        F.when(size > 0, label(F.try_element_at(months, F.lit(1)))).alias("first_month"),
        F.when(size > 0, label(F.try_element_at(months, F.lit(-1)))).alias("last_month"),
        F.coalesce("stations.ids", "stations.rows").alias("stations"),
        F.col("parameters.rows").alias("parameters"),
    )


def files_catalog(manifest_row: DataFrame) -> DataFrame:
    """The two dimension tables, then one entry per month."""
    tables = [
        manifest_row.select(F.col(f"{kind}.key").alias("key"), F.lit(kind).alias("kind"), F.col(f"{kind}.bytes").alias("bytes"))
        for kind in ("stations", "parameters")
    ]
    months = tree.manifest_months(manifest_row).select(
        "key", F.lit("measurements").alias("kind"), "year", "month", "rows", "bytes"
    )
    return (
        tables[0]
        .unionByName(tables[1])
        .unionByName(months, allowMissingColumns=True)
        .select("key", "kind", "year", "month", "rows", "bytes")
    )


def visible_files(catalog: DataFrame, years: list[int]) -> DataFrame:
    """Keys open to a caller limited to some years: dimension tables, manifest, those years' months."""
    # Fixed patterns of the published keys.
    table = r"^v1/(stations\.parquet|parameters\.parquet|_?manifest\.json)\z"
    month = r"^v1/measurements/year=(\d{4})/month=\d{2}(/.*)?\z"
    key = F.col("key")
    year = F.regexp_extract(key, month, 1)
    return catalog.where(key.rlike(table) | (key.rlike(month) & year.isin([str(y) for y in years])))


def size_by_year(months: DataFrame) -> DataFrame:
    """Rows and megabytes by year, years as rows; halves round to even."""
    return months.groupBy("year").agg(
        F.bround(F.sum("rows").cast("double"), 0).alias("rows"),
        F.bround(F.sum(F.col("bytes") / F.lit(1e6)), 0).alias("mb"),
    )


def size_across_years(months: DataFrame, years: list[int]) -> DataFrame:
    """The same with one row per measure and one column per year."""
    long = size_by_year(months).unpivot("year", ["rows", "mb"], "measure", "amount")
    return long.groupBy("measure").pivot("year", years).agg(F.max("amount"))


def missing_months(calendar: DataFrame, months: DataFrame) -> DataFrame:
    """Every expected month with its published rows; `present` is false for a gap."""
    published = months.select(F.make_date("year", "month", F.lit(1)).alias("month"), "rows")
    return calendar.join(published, "month", "left").select(
        "month", F.col("rows").isNotNull().alias("present"), F.coalesce("rows", F.lit(0)).alias("rows")
    )
