"""WARC archives: written with revisit records for repeated payloads, and read back in sequence.

Every record is a gzip member of its own. The reader takes a stream in pieces, inflates it a piece at
a time, frames records by Content-Length and recomputes the digests they state; anything that does
not add up is an error. Archives are written and read by the tasks themselves through
`pyarrow.fs`, in the folder all of them share, which is resolved as Spark resolves it; a store that
tasks cannot open is refused. A file gets its name only when it is complete, so a task that runs again
replaces its files and leaves none half written.

Which record holds a payload is decided by Spark before: of the pages with equal payloads the one
with the largest id is the response, and the others revisit it.

Defined cases: a null html is an empty payload. A null url is written as `about:blank`, control
characters and blanks in a url are escaped. A page without an id counts as smaller than any; if no
page of equal payloads has one, each is a response, and so are repeated rows that share the largest
id. An empty table gives no archive. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.folders import shared_uri
from hourmark.runtime import cut, new_path, small_side

# Parameters: bytes of an archive before the next one is begun, bytes read at a time, rows of a batch.
ARCHIVE_BYTES = 64 << 20
CHUNK = 64 << 10
BATCH = 256
MOST_READERS = 20_000
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
END = b"\r\n\r\n"

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page `refers_to`."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{PAGE}{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{PAGE}{refers_to}>"}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + END) + packer.flush()


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member; a member must be used up before the next is asked for."""
    left = stream.read(chunk)
    while left:
        inflater = zlib.decompressobj(31)
        rest: list[bytes] = []

        def pieces(data: bytes = left, inflater=inflater, rest=rest) -> Iterator[bytes]:
            while True:
                piece = inflater.decompress(data, chunk)
                if piece:
                    yield piece
                if inflater.eof:
                    rest.append(inflater.unused_data)
                    return
                data = inflater.unconsumed_tail or stream.read(chunk)
                if not data and not piece:
                    raise ValueError("an archive ends inside a record")

        yield pieces()
        if not rest:
            raise ValueError("a record was not read to its end")
        left = rest[0] or stream.read(chunk)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def read_records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of every record, verified; a revisit has no payload."""
    for pieces in members(stream, chunk):
        buffer = bytearray()
        for piece in pieces:
            buffer += piece
            if END in buffer:
                break
        head, found, rest = bytes(buffer).partition(END)
        if not found or not head.startswith(b"WARC/"):
            raise ValueError("a record has no header")
        fields = _fields(head)
        wanted = int(fields["content-length"])
        block = bytearray(rest)
        for piece in pieces:
            block += piece
            if len(block) > wanted + len(END):
                break
        if len(block) != wanted + len(END) or not block.endswith(END):
            raise ValueError("a record is not as long as it says")
        block = bytes(block[:wanted])
        if fields["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError("a block does not have the digest it states")
        http, _, payload = block.partition(END)
        if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise ValueError("a payload does not have the digest it states")
        yield fields, _fields(http), payload


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): the pages as records are to be written.

    What is decided, on digests and ids alone, is a row per payload that occurs more than once. While
    these are few they are sent to the pages, which stay where they are read; else both are shuffled.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    same = F.unhex(F.sha2(payload, 256)).alias("same")
    shared = pages.select(same, "page_id").groupBy("same").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.where("n > 1 AND holder IS NOT NULL").drop("n"))
    own = pages.select("page_id", "url", payload.alias("payload"), same)
    revisits = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    joined = own.join(small_side(shared), "same", "left")
    return joined.select("page_id", "url", "payload", F.when(revisits, F.col("holder")).alias("refers_to"))


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _opener(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _writer(uri: str, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _opener(uri)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        done, stream = 0, None

        def close() -> pd.DataFrame:
            stream.close()
            path = f"{root}/part-{part:06d}-{done:04d}.warc.gz"
            store.move(partial, path)
            return pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, refers_to in batch.itertuples(index=False):
                if stream is None:
                    partial, records, size = f"{root}/.part-{part:06d}-{attempt}-{done:04d}", 0, 0
                    stream = store.open_output_stream(partial)
                made = record(_whole(page_id), url, bytes(payload), _whole(refers_to))
                stream.write(made)
                records, size = records + 1, size + len(made)
                if size >= most:
                    yield close()
                    done, stream = done + 1, None
        if stream is not None:
            yield close()

    return write


def _reader(uri: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def page(name: str | None) -> int | None:
        value = (name or "").removeprefix(f"<{PAGE}").removesuffix(">")
        return int(value) if value else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _opener(uri)
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, http, _ in read_records(stream):
                        rows.append(
                            (
                                page(fields["warc-record-id"]),
                                int(http["content-length"]),
                                fields["warc-payload-digest"].removeprefix("sha1:"),
                                fields["warc-type"],
                                page(fields.get("warc-refers-to")),
                            )
                        )
                        if len(rows) == 4096:
                            yield _frame(rows, columns)
                            rows = []
                if rows:
                    yield _frame(rows, columns)

    return read


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def write_archives(pages: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives into `folder`; returns their manifest: path, records, bytes."""
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    uri = shared_uri(spark, f"{folder}/archives")
    store, root = _opener(uri)
    store.create_dir(root, recursive=True)
    decided(pages).mapInPandas(_writer(uri, most), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives the manifest lists, about an archive to a task."""
    return manifest.select("path").repartition(min(max(1, manifest.count()), MOST_READERS)).mapInPandas(_reader(shared_uri(manifest.sparkSession, folder)), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder and read the records back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
