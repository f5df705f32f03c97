"""Publishing: new folders, the tables derived from them, the manifest, and only then deletions.

A run writes folders of its own, one per month, and never changes one. The manifest names the folder of
every month, and readers go by it, so the tree is what it was until the new manifest is in its place, and
complete from then on. Folders that a run replaced are deleted last. A run that stops halfway leaves
folders no manifest names; the next run of those months deletes them first.

A run costs what it touches: the months asked for, the series summaries of their years, and one
summary per other year. Nothing of other months is opened or listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark import schema as S
from hourmark.functions import time as t
from hourmark.operators import series
from hourmark.operators.fact import fact_by_month, key_counts
from hourmark.operators.stations import require_unique
from hourmark.runtime import cut, new_path
from hourmark.sources import tree

# A month is cut into files of at most this many rows.
FILE_MAX_ROWS = 50_000_000
TABLES = ("stations", "parameters")


@dataclass
class Published:
    months: list[date]
    removed: list[date]
    manifest: DataFrame


# -- folders --------------------------------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    handle, files = tree.file_system(spark, path)
    return files.exists(handle)


def delete(spark: SparkSession, path: str) -> None:
    handle, files = tree.file_system(spark, path)
    files.delete(handle, True)


def month_folder(kind: str, month: date) -> str:
    return f"{S.SCHEMA_VERSION}/{kind}/year={month.year}/month={month.month:02d}"


def year_folder(year: int) -> str:
    return f"{S.SCHEMA_VERSION}/series_years/year={year}"


def table_folder(kind: str) -> str:
    return f"{S.SCHEMA_VERSION}/{kind}.parquet"


def named_folders(manifest: dict | None) -> set[str]:
    """The folders that make up a tree: two per month, one per year, and the tables."""
    if manifest is None:
        return set()
    months = manifest["measurements"]["months"]
    found = {m["folder"] for m in months} | {m["series"] for m in months} | {y["folder"] for y in manifest["series_years"]}
    return found | {manifest[kind]["folder"] for kind in TABLES}


def run_folders(spark: SparkSession, root: str, parent: str) -> list[str]:
    """What the runs so far have left in the folder of a month, a year or a table."""
    handle, files = tree.file_system(spark, f"{root.rstrip('/')}/{parent}")
    return [f"{parent}/{s.getPath().getName()}" for s in files.listStatus(handle)] if files.exists(handle) else []


def delete_folders(spark: SparkSession, root: str, folders: set[str]) -> None:
    for folder in sorted(folders):
        delete(spark, f"{root.rstrip('/')}/{folder}")


def _size(spark: SparkSession, root: str, folder: str) -> tuple[int, int]:
    """Bytes and files of a folder."""
    handle, files = tree.file_system(spark, f"{root.rstrip('/')}/{folder}")
    found = files.getContentSummary(handle)
    return found.getLength(), found.getFileCount()


def _switch(spark: SparkSession, text: str, path: str) -> None:
    """Put the text in place of the file in one step."""
    fresh, files = tree.file_system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    options = getattr(fs, "Options$Rename")
    overwrite = spark._sc._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, fs.Path(path), overwrite)


# -- steps --------------------------------------------------------------------


def write_months(df: DataFrame, path: str, order: list[str], row_group: int = S.ROW_GROUP_ROWS, run: str | None = None) -> None:
    """Add files to the months `df` has rows for, in a folder of the run where one is given.

    Every file is sorted by `order`, so its row groups cover narrow ranges of stations. The sort
    begins with the partition columns, which spares the writer one of its own.
    """
    parts = ["year", "month"] if run is None else ["year", "month", "run"]
    (
        (df if run is None else df.withColumn("run", F.lit(run)))
        .sortWithinPartitions(*parts, *order)
        .write.mode("append")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", row_group)
        .option("maxRecordsPerFile", FILE_MAX_ROWS)
        .partitionBy(*parts)
        .parquet(path)
    )


def stale_months(asked: DataFrame, produced: DataFrame, existing: DataFrame) -> DataFrame:
    """Months asked for that brought no rows but are still in the tree."""
    return asked.join(produced, "month", "left_anti").join(existing, "month", "left_semi")


def _month(entry: dict) -> date:
    return date(entry["year"], entry["month"], 1)


def _summarise(spark: SparkSession, root: str, entries: list[dict], run: str) -> None:
    """Write the series summaries of some months in folders of the run, by reading only those months."""
    if not entries:
        return
    fact = tree.read_folders(spark, root, [m["folder"] for m in entries], S.FACT, f"{S.SCHEMA_VERSION}/measurements")
    padded = series.series_summary(fact, "year", "month").withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    # a month's summary is small: a row per series, in a file or a few
    write_months(padded.repartition("year", "month"), tree.series_path(root), ["station_id", "parameter_name"], run=run)
    for m in entries:
        m["series"] = f"{month_folder('series', _month(m))}/run={run}"


def _series_of(spark: SparkSession, root: str, entries: list[dict]) -> DataFrame:
    return tree.read_folders(spark, root, [m["series"] for m in entries], base=f"{S.SCHEMA_VERSION}/series")


def _summed_rows(spark: SparkSession, root: str, entries: list[dict]) -> dict[tuple[int, int], int]:
    """How many readings the summaries of some months account for, a number per month."""
    if not entries:
        return {}
    sums = _series_of(spark, root, entries).groupBy(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))
    return {(r.year, r.month): r.n for r in sums.agg(F.sum("n").alias("n")).collect()}


def _add_up(summary: DataFrame, *extra: str) -> DataFrame:
    return summary.groupBy(*extra, *S.SERIES_KEY).agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def _write_years(spark: SparkSession, root: str, entries: list[dict], run: str) -> None:
    """Add the summaries of some months up by year, in folders of the run."""
    if entries:
        years = _add_up(_series_of(spark, root, entries), "year").withColumn("run", F.lit(run))
        placed = years.repartition("year").sortWithinPartitions("year", "run", "station_id", "parameter_name")
        placed.write.mode("append").option("compression", "zstd").partitionBy("year", "run").parquet(tree.series_years_path(root))


def published_series(spark: SparkSession, root: str) -> DataFrame:
    """The summary of every series over all months, from one table per year."""
    return _all_series(spark, root, (tree.load_manifest(spark, root) or {}).get("series_years", []))


def _all_series(spark: SparkSession, root: str, years: list[dict]) -> DataFrame:
    if not years:
        raise ValueError(f"nothing has been published under {root}")
    return _add_up(tree.read_folders(spark, root, [y["folder"] for y in years]))


def write_dimensions(
    spark: SparkSession, root: str, station_dim: DataFrame, years: list[dict], run: str, each_description: bool = False
) -> dict[str, dict]:
    """Write the station and parameter tables of all series, described by `station_dim`. Returns their entries."""
    summary = cut(_all_series(spark, root, years))
    made = {
        "stations": series.in_listing_order(series.stations_table(summary, station_dim, each_description)),
        "parameters": series.by_size(series.parameters_table(summary)),
    }
    entries = {}
    for kind, table in made.items():
        folder = f"{table_folder(kind)}/run={run}"
        table.write.option("compression", "zstd").parquet(f"{root.rstrip('/')}/{folder}")
        rows = tree.read_folders(spark, root, [folder]).count()
        entries[kind] = {"rows": rows, "key": table_folder(kind), "bytes": _size(spark, root, folder)[0], "folder": folder}
    if each_description:
        entries["stations"]["ids"] = summary.select("station_id").distinct().count()
    return entries


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    _switch(spark, json.dumps(manifest, indent=2, ensure_ascii=False), tree.manifest_path(root))


def _new_months(spark: SparkSession, root: str, asked: list[date], run: str) -> list[dict]:
    """Entries of the months that a run has written files for; their rows are counted with their series."""
    entries = []
    for month in asked:
        folder = f"{month_folder('measurements', month)}/run={run}"
        if exists(spark, f"{root.rstrip('/')}/{folder}"):
            size, files = _size(spark, root, folder)
            key = tree.month_key(month.year, month.month)
            entries.append({"year": month.year, "month": month.month, "bytes": size, "files": files, "key": key, "folder": folder})
    return entries


def _models(spark: SparkSession, root: str, old: dict | None, asked: list[date]) -> dict[date, date]:
    """For every month the published one whose counts it is expected to have: itself or, if it is new, the month
    before it that was published. Empty where one of them has none, or its summary is gone."""
    entries = {_month(m): m for m in tree.month_entries(old)}
    model = {month: max((known for known in entries if known <= month), default=None) for month in asked}
    if not all(model.values()) or not all(exists(spark, f"{root.rstrip('/')}/{entries[m]['series']}") for m in set(model.values())):
        return {}
    return model


def _expected(spark: SparkSession, root: str, old: dict | None, asked: list[date], raw: DataFrame, station_dim: DataFrame) -> DataFrame:
    """How many readings to expect (year, month, station_id, parameter_name, n): what a month was last published
    with or, if it is new, the month before it that was; in a tree without such months they are counted."""
    model = _models(spark, root, old, asked)
    if not model:
        return key_counts(raw, station_dim)
    entries = {_month(m): m for m in tree.month_entries(old)}
    known = _series_of(spark, root, [entries[m] for m in sorted(set(model.values()))])
    alike = spark.createDataFrame([(k.year, k.month, m.year, m.month) for m, k in model.items()], "year int, month int, as_year int, as_month int")
    counts = known.select(F.col("year").cast("int"), F.col("month").cast("int"), "station_id", "parameter_name", "n")
    counts = counts.join(F.broadcast(alike), ["year", "month"])  # calendar months
    return counts.groupBy(F.col("as_year").alias("year"), F.col("as_month").alias("month"), "station_id", "parameter_name").agg(F.sum("n").alias("n"))


def _years_to_add_up(spark: SparkSession, root: str, kept: list[dict], years: list[dict]) -> set[int]:
    """Years whose summary is gone or does not account for their months."""
    rows: dict[int, int] = {}
    for m in kept:
        rows[m["year"]] = rows.get(m["year"], 0) + m["rows"]
    right = {y["year"] for y in years if y["rows"] == rows.get(y["year"]) and exists(spark, f"{root.rstrip('/')}/{y['folder']}")}
    return set(rows) - right


def publish(
    spark: SparkSession,
    root: str,
    readings: Callable[[list[date]], DataFrame],
    station_dim: DataFrame,
    months: DataFrame,
    exported_at: str | None = None,
    batch: tuple[str, int] | None = None,
    each_description: bool = False,
) -> Published:
    """Publish `months` (one date per row; none rebuilds the dimension tables only).

    `readings` returns the raw readings of the months it is given, so that a source can be asked for
    just those. All months are written by one job; what the manifest says of other months is carried
    over. A month asked for that has no readings is removed. In the years it touches, a summary that does
    not account for its month is made again. `batch` is the name of a stream and the number of its batch: one that
    the manifest already has is done. One run at a time may publish to a tree.

    A dimension that describes a raw id more than once is refused, like one in which two raw ids share a
    public id. With `each_description` the first is taken as a join takes it: the readings are published
    under each description, and the station table lists each.
    """
    old = tree.load_manifest(spark, root)
    batches = dict((old or {}).get("batches") or {})
    if batch is not None:
        if batches.get(batch[0], -1) >= batch[1]:
            return Published([], [], tree.read_manifest(spark, root))
        batches[batch[0]] = batch[1]
    run = f"r{uuid.uuid4().hex}"
    dim_path = new_path(spark, "station-dim")
    station_dim.write.parquet(dim_path)
    try:
        station_dim = require_unique(spark.read.parquet(dim_path), each_description)
        asked = [r.month for r in months.distinct().orderBy("month").collect()]  # calendar months
        named = named_folders(old)
        years = {m.year for m in asked}
        places = [month_folder(kind, m) for m in asked for kind in ("measurements", "series")]
        places += [*map(year_folder, sorted(years)), *map(table_folder, TABLES)]
        delete_folders(spark, root, {f for p in places for f in run_folders(spark, root, p)} - named)

        fresh = []
        if asked:
            # a month overwritten with a stray reading would lose the rest of it
            raw = readings(asked).where(t.in_months(F.col("collected_at"), asked))
            # without counts to go by, Spark's sample of the keys costs less than counting them all
            expected = _expected(spark, root, old, asked, raw, station_dim) if _models(spark, root, old, asked) else None
            write_months(fact_by_month(raw, station_dim, expected), tree.measurements_path(root), S.SORT_KEY, run=run)
            fresh = _new_months(spark, root, asked, run)
        produced = [_month(m) for m in fresh]
        before = tree.month_entries(old)
        removed = sorted({_month(m) for m in before} & set(asked) - set(produced))
        kept = [dict(m) for m in before if _month(m) not in set(asked)]

        known_years = [y for y in (old or {}).get("series_years", []) if y["year"] not in years]
        years |= _years_to_add_up(spark, root, [m for m in kept if m["year"] not in years], known_years)
        touched = [m for m in kept if m["year"] in years]
        gone = [m for m in touched if not exists(spark, f"{root.rstrip('/')}/{m['series']}")]
        _summarise(spark, root, fresh + gone, run)
        rows = _summed_rows(spark, root, fresh + touched)
        for m in fresh:
            m["rows"] = rows[m["year"], m["month"]]
        wrong = [m for m in touched if rows.get((m["year"], m["month"])) != m["rows"]]
        if wrong:
            _summarise(spark, root, wrong, f"{run}b")
        _write_years(spark, root, fresh + touched, run)

        entries = sorted(fresh + kept, key=_month)
        sums: dict[int, int] = {}
        for m in entries:
            sums[m["year"]] = sums.get(m["year"], 0) + m["rows"]
        known_years = [y for y in known_years if y["year"] not in years]
        known_years += [{"year": y, "rows": n, "folder": f"{year_folder(y)}/run={run}"} for y, n in sums.items() if y in years]
        manifest = {
            "schema_version": S.SCHEMA_VERSION,
            "exported_at": exported_at or datetime.now(timezone.utc).isoformat(timespec="seconds"),
            "timezone_note": S.TIMEZONE_NOTE,
            "columns": S.COLUMN_NOTES,
            "measurements": {"rows": sum(m["rows"] for m in entries), "bytes": sum(m["bytes"] for m in entries), "months": entries},
            **write_dimensions(spark, root, station_dim, known_years, run, each_description),
            "series_years": sorted(known_years, key=lambda y: y["year"]),
            "batches": batches,
        }
        write_manifest(spark, root, manifest)
        delete_folders(spark, root, named - named_folders(manifest))
    finally:
        delete(spark, dim_path)
    return Published(produced, removed, tree.read_manifest(spark, root))
