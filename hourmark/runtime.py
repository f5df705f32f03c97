"""Session settings, the shared work folder and the size check in front of every broadcast."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a table may have and still be sent to every executor. The tables this is asked about are
# station-shaped (some 200 bytes a row), so the bound is about 40 MB.
BROADCAST_MAX_ROWS = 200_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # also the target size of the pieces a rebalanced month is written in
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when nothing refers to them any more, which a stream of small runs needs
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # lists of stations reach the row groups value by value, not as the range they span
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

_serial = itertools.count()


def session(name: str = "hourmark", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the jobs are written for; `settings` override them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set on a session built elsewhere what results depend on: times are rendered in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or the one set on the context.

    Only a local master gets a temporary folder when neither is set.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="hourmark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/hourmark-{app}/{label}-{next(_serial)}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Counted in full: a limit would bring that many rows of every task to a single one."""
    return df.count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Mark `df` for broadcast if a count shows it small enough; a shuffled join is used beyond."""
    return F.broadcast(df) if is_small(df, max_rows) else df
