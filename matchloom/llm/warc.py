"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing builds records as Spark expressions; Spark's own writer commits them, with the
record terminator as line separator, so any shared file system and lost executors are
covered.  Archives are kept to a bounded size and compressed as a whole; offsets are those of the uncompressed bytes.

Reading doesn't trust the magic bytes.  Tasks emit every place that looks like a record
head, with the place of its successor by its Content-Length.  From these candidate links
pointer jumping, doubling the step each round, finds what the chain from the start
of the file reaches; magic inside payloads is off the chain and goes.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import durable

#: Payload bytes in an archive, about, and least bytes of a payload that may be revisited.
ARCHIVE_BYTES, REVISIT_BYTES = 16 << 20, 1000
#: Most tasks that write; beyond, each rolls over to a new archive after twice the mean archive's number of records.
WRITERS = 8192
#: Most places (8 bytes each) and groups of equal payloads (60 bytes each) that are broadcast.
FEW, FEW_GROUPS = 1_000_000, 200_000
END = "\r\n\r\n"
_TEXTS = (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest")
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Writes one record per row below ``path``.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the largest id is the
    response and the others revisit it; smaller payloads are always responses.  A null payload is empty, a
    null id is smaller than any other (and revisits, or, if all are null, is a response), rows that share the
    largest id are responses alike; white space in urls is percent-encoded and a null url left out.
    Other columns play no part.  An empty table writes no archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload")})
    groups = (
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
        .agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    )
    # Few groups, by count, go to the rows, which then move once; else both meet by digest.
    groups = durable(groups, "groups")
    rows = rows.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, ["digest", "size"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[ \t]", "%20")
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("response"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), http.cast("binary"), body).cast("string")
    total = pages.agg(F.sum(F.octet_length(payload)).alias("b"), F.count("*").alias("n")).first()
    files = 1 + ((total["b"] or 0) + 500 * total["n"]) // ARCHIVE_BYTES
    out = rows.repartition(int(min(files, WRITERS)), F.xxhash64("id", "digest", "url")).select(record.alias("value"))
    out.write.options(lineSep=END, compression="gzip", maxRecordsPerFile=100 + 2 * total["n"] // files).text(path)


_NAMES = ["path", "offset", "next", "record_type", "record_id", "refers_to", "digest", "size", "payload"]
_RECORD = (
    "path string, offset long, next long, record_type string, record_id string, refers_to string, digest string, size long, payload binary"
)


def _record(path: str, data: bytes, at: int, whole: bool) -> tuple | None:
    """The record whose head starts at a place, or None if there is no head with a length; ``whole`` reads its block too."""
    head = _HEAD.match(data, at)
    fields = _fields(head[1]) if head else {}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None
    end = head.end() + int(length)
    if not whole:
        return (path, at, end + len(END))
    http, _, payload = data[head.end() : end].partition(b"\r\n\r\n")
    size = _fields(http).get(b"content-length", b"")
    text = [fields[k].decode("utf-8", "replace") if k in fields else None for k in _TEXTS]
    return (path, at, end + len(END), *text, int(size) if size.isdigit() else len(payload), payload)


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def candidates(archives: DataFrame) -> DataFrame:
    """(path, offset, next) of all places in (path, content) rows that look like a record head."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = _plain(content)
                found = [r for m in _MAGIC.finditer(data) if (r := _record(path, data, m.start(), False))]
                yield pd.DataFrame(found, columns=_NAMES[:3])

    return archives.select("path", "content").mapInPandas(run, "path string, offset long, next long")


def records(archives: DataFrame) -> DataFrame:
    """The records at the given places of (path, content, offsets) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content, offsets in zip(pdf["path"], pdf["content"], pdf["offsets"], strict=True):
                data, rows, held = _plain(content), [], 0
                for at in offsets:
                    rows.append(_record(path, data, int(at), True))
                    held += len(rows[-1][-1])
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=_NAMES)

    return archives.select("path", "content", "offsets").mapInPandas(run, _RECORD)


def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for row in head.split(b"\r\n"):
        key, colon, value = row.partition(b":")
        if colon:
            out[key.strip().lower()] = value.strip()
    return out


def reached(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets the chain from offset 0 reaches: pointer jumping in log n rounds."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    there = at < n
    there[there] = offset[at[there]] == successor[there]
    jump = np.append(np.where(there, at, n), n)  # n: the end, its own successor
    seen = np.zeros(n + 1, bool)
    seen[n] = True
    if n and offset[0] == 0:
        seen[0] = True
        for _ in range(n.bit_length()):
            seen[jump[seen]] = True
            jump = jump[jump]
    return seen[:n]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chains of all archives below ``path``; bytes after a broken link aren't records.

    Columns: path, offset, next, record_type, record_id, refers_to, digest, size (of the full payload), payload.  Candidate
    links are narrow rows, and those of one archive, which has a bounded size, meet in a task.  Verified places are one row per
    archive; they go to the archives, or, where they are too many to broadcast, meet them by path, still compressed.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        on = reached(group["offset"].to_numpy(), group["next"].to_numpy())
        return pd.DataFrame({"path": [group["path"].iloc[0]], "offsets": [group["offset"].to_numpy()[on]]})

    found = candidates(archives).groupBy("path").applyInPandas(chain, "path string, offsets array<long>")
    good = durable(found, "chain")
    few = (good.agg(F.sum(F.size("offsets"))).first()[0] or 0) <= FEW
    return records(archives.select("path", "content").join(F.broadcast(good) if few else good.hint("shuffle_hash"), "path"))
