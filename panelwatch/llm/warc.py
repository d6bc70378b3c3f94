"""Dictionary-compressed web archives: write records with a shared Zstandard dictionary, read them back.

A dictionary is built from a bounded sample of the archived records. Every file starts
with a skippable frame that holds the dictionary; each record after it is a frame of its
own, so a reader needs nothing but the file and can stop at any record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch.llm.common import cut, in_ids, sample_ids, scratch

#: Magic number of the skippable frame that holds a dictionary, WARC version line, revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def record_plan(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 100) -> DataFrame:
    """Payload, digest and record type of every page.

    Of equal payloads of at least ``min_bytes`` the smallest key is the response and the others
    revisit it. Only digests that occur more than once are joined back; the count is combined
    before its shuffle and a hot digest is split by the skew join.

    A null payload is an empty one. Rows that repeat the smallest key with the same payload are
    responses too; a null key never becomes a response that others refer to, unless no other is there.
    """
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    base = base.withColumns({"digest": F.sha2(F.encode("payload", "utf-8"), 256), "n": F.octet_length("payload").cast("long")})
    copies = base.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    revisit = F.expr("first_id IS NOT NULL AND NOT (page_id <=> first_id)")
    return base.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", "n", F.when(revisit, F.col("first_id")).alias("refers_to"))


def build_dictionary(plan: DataFrame, rows: int = 400, row_bytes: int = 1 << 16, size: int = 1 << 15) -> bytes:
    """A Zstandard dictionary of at most ``size`` bytes from the records of at most ``rows`` pages of ``record_plan``,
    of at most ``row_bytes`` each.

    The bound (25 MB at most) is what makes the sample fit on the driver. Too few samples to
    train on give a dictionary of plain content; none at all gives an empty one.
    """
    fit = plan.where(F.col("n").between(1, row_bytes) & F.col("refers_to").isNull()).select("page_id", "url", "payload", "digest", "n")
    ids = sample_ids(fit, "page_id", rows)
    samples = [encode_record(*r, None) for r in sorted(fit.where(in_ids(F.col("page_id"), ids)).limit(rows).collect(), key=lambda r: (r.page_id, r.digest))]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def _name(page_id) -> str:
    return "null" if page_id is None or page_id != page_id else str(int(page_id))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)]) + b"\r\n\r\n"


def encode_record(page_id, url, payload: str, digest: str, n: int, refers_to) -> bytes:
    """One record; a revisit has the digest and length of the full payload but no payload."""
    line = " ".join((url or "").split())
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{_name(page_id)}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", line)] * (url is not None) + [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(int(n)))]
    if refers_to is not None:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:x-page:{_name(refers_to)}>")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload.encode() if refers_to is None else http
    return _header([*fields, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple | None:
    """Back to a row of ``RECORD``; null for records that are not of a page."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    number = lambda k: None if (v := fields.get(k, "<urn:x-page:null>")[12:-1]) == "null" else int(v)
    page = (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"])
    if page[2] == "revisit":
        return (*page, number("WARC-Refers-To"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None)
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    return (*page, None, len(payload), hashlib.sha256(payload).hexdigest(), payload.decode())


def write_archive(plan: DataFrame, folder: str, dictionary: bytes, level: int = 6, roll_bytes: int = 1 << 26) -> DataFrame:
    """Write the records of ``record_plan`` below ``folder`` and return the manifest of the files.

    Each task writes files of about ``roll_bytes``, named by its attempt; a file counts only if its
    attempt ended well and stands in the manifest, so attempts of lost executors leave no double records.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, press = TaskContext.get(), _compressor(dictionary, level)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        info = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Length", "0")]) + b"\r\n\r\n"
        out, done, path, n, size = None, [], "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{path}", n, size))
                out = None

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if out is None:
                    path, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst", 0
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                    size = out.write(lead) + out.write(press.compress(info))
                refers = None if pd.isna(row.refers_to) else row.refers_to
                size += out.write(press.compress(encode_record(row.page_id, row.url, row.payload, row.digest, row.n, refers)))
                n += 1
                if size >= roll_bytes:
                    close()
        close()
        if done:
            yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return cut(plan.select("page_id", "url", "payload", "digest", "n", "refers_to").mapInPandas(write, MANIFEST))


def frames(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The decompressed frames of an archive file, one at a time, by the dictionary in its leading frame."""
    magic, n = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start of the archive")
    unpack, view, at = _decompressor(content[8 : 8 + n]), memoryview(content), 8 + n
    while at < len(view):
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            chunk = view[at : at + step]
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def read_archive(spark: SparkSession, paths: list[str], batch: int = 256) -> DataFrame:
    """All page records of the files, one task or more per file, with payloads where the record has one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows, held = [c.split()[0] for c in RECORD.split(", ")], [], 0
        kinds = {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"}
        for pdf in batches:
            for content in pdf["content"]:
                for frame in frames(content):
                    if (row := decode_record(frame)) is not None:
                        rows.append(row)
                        held += len(frame)
                    if len(rows) >= batch or held >= 1 << 24:
                        yield pd.DataFrame(rows, columns=names).astype(kinds)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names).astype(kinds)

    if not paths:
        return spark.createDataFrame([], RECORD)
    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(read, RECORD)


def archive(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 100) -> DataFrame:
    """Write all pages to archives in the shared folder and return the manifest.

    Null payloads are archived as empty ones, an empty table gives an empty manifest, further
    columns are ignored whatever their names.
    """
    folder = scratch(pages.sparkSession, "warc")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    plan = record_plan(pages, key, payload, url, min_bytes)
    return write_archive(plan, folder, build_dictionary(plan))
