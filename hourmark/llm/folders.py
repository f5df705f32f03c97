"""Folders of the shared store, through the file system that the session has for them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    handle, files = _opened(spark, path)
    return files.getContentSummary(handle).getLength()


def remove(spark: SparkSession, path: str) -> None:
    handle, files = _opened(spark, path)
    files.delete(handle, True)


# Schemes that tasks can write to themselves, and what their own file systems call them.
TASK_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def task_uri(qualified: str) -> str:
    """A fully qualified path as the address that tasks open it by; ValueError where they cannot."""
    scheme, _, rest = qualified.partition(":")
    if scheme not in TASK_SCHEMES:
        raise ValueError(f"tasks cannot write to {qualified}: name a folder of one of {', '.join(TASK_SCHEMES)}")
    return f"{TASK_SCHEMES[scheme]}://{rest.removeprefix('//')}"


def shared_uri(spark: SparkSession, path: str) -> str:
    """The address of a folder for tasks. A path without a scheme is where Spark itself would look for it, on the
    session's default file system, and not on the disk of whoever opens it."""
    handle, files = _opened(spark, path)
    return task_uri(files.makeQualified(handle).toString())
