"""WARC archives written by Spark tasks and read back by a splittable reader.

Writing: each task streams its rows into archives of gzip members, one record a member, closes an
archive at about ``ARCHIVE_BYTES`` and moves it into place under a name of its own; the returned table of
archives is what readers use, so files of tasks that ran twice or died are never read.

Reading: archives are cut into byte ranges. A task looks for gzip magic in its range, accepts a place as
a record's beginning only if the member there decodes to a WARC version line, and owns the records
that begin inside its range, reading beyond its end to finish the last one.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh_path, written

ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
#: Tasks that ranges are dealt to at most; each reads several ranges where there are more.
READ_TASKS = 20_000
MIN_REVISIT_BYTES = 100
MAGIC = b"\x1f\x8b\x08"
_AHEAD = 1 << 20

PAGE = "page_id long, url string, html string"
ARCHIVES = "path string, bytes long, records long"
RECORDS = "path string, start long, record_type string, record_id string, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, uri: str | None, kind: str, refers_to: int | None, payload: bytes, digest: str, serial: str) -> bytes:
    """One record; a revisit has headers alone, with the length and digest of the payload it stands for."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{serial}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {uri}"] if uri is not None else []
    lines += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + head + payload + b"\r\n\r\n"


def _clean(uri: str | None) -> str | None:
    return None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A")


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to) for rows with those first three.

    Of rows with equal payloads of ``MIN_REVISIT_BYTES`` or more the one with the smallest page_id is the
    response; rows that repeat that page_id are responses too. A null page_id is never the smallest
    unless all are null; then all are responses. Null html is the empty payload.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long = pages.where(F.octet_length("html") >= MIN_REVISIT_BYTES)
    # Only payloads that do repeat, with their response, come back to the pages; the texts do not move for it.
    first = long.groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    joined = pages.join(first, "digest", "left")
    repeat = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select(
        "page_id", "url", "html", "digest", F.when(repeat, "revisit").otherwise("response").alias("record_type"), F.when(repeat, F.col("response")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives with a record for each row of ``pages`` (page_id, url, html; other columns are left out).

    Returns (path, bytes, records) of each archive, already written. Empty input writes no archive.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, count, made = None, "", 0, 0, []

        def close():
            out.close()
            fs.move(f"{base}/.{name}.part", f"{base}/{name}")
            made.append((f"{folder}/{name}", size, count))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/.{name}.part", compression=None)
                payload = row["html"].encode("utf-8", "replace")
                raw = record(row["page_id"], _clean(row["url"]), row["record_type"], row["refers_to"], payload, row["digest"], str(uuid.uuid4()))
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "bytes", "records"])

    return written(with_revisits(pages).mapInArrow(write, ARCHIVES), "archives")


def members(source: "Window", start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the records that begin in [start, stop) of an archive."""
    at = start
    while (at := source.find(MAGIC, at, stop)) >= 0:
        got = decode(source, at)
        if got is None:
            at += 1  # the magic stood inside a member
        else:
            yield at, got[0]
            at = got[1]


def decode(source: "Window", at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at a place, or None when it is no record."""
    unpacker = zlib.decompressobj(31)
    parts, place, seen = [], at, b""
    try:
        while not unpacker.eof:
            block = source.read(place, 1 << 16)
            if not block:
                return None
            parts.append(unpacker.decompress(block))
            place += len(block)
            if len(seen) < 5:
                seen = (seen + parts[-1])[:5]
                if not b"WARC/".startswith(seen):
                    return None
    except zlib.error:
        return None
    return (b"".join(parts), place - len(unpacker.unused_data)) if seen == b"WARC/" else None


class Window:
    """Reads places of one file through a buffer that moves forward."""

    def __init__(self, file, size: int, ahead: int = _AHEAD):
        self.file, self.size, self.ahead, self.at, self.held = file, size, ahead, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """At most n bytes from a place; fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, self.ahead), self.size - at), at) if n else b""
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, start: int, stop: int) -> int:
        """The first place in [start, stop) where ``what`` stands, or -1."""
        while start < stop:
            block = self.read(start, min(self.ahead, stop - start) + len(what) - 1)
            found = block.find(what)
            if found >= 0 and start + found < stop:
                return start + found
            start += max(1, len(block) - len(what) + 1)
        return -1


def parse(content: bytes) -> dict[str, object] | None:
    """Headers and payload of a record; None when its header block has no end."""
    head, gap, body = content.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    block = body[: int(length)] if length.isdigit() else body
    _, blank, payload = block.partition(b"\r\n\r\n")
    return fields | {"payload": payload if blank else block}


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each record of the archives (path, bytes): see ``RECORDS``, with ``page_id`` first.

    Length and digest are computed from the payload of a response and taken from the headers of a
    revisit. Records whose digest header does not fit their payload raise an error. Bytes that are no
    record are passed over. Without ``payloads`` the payload column is null. There is a task for each range,
    up to ``READ_TASKS``; a record longer than a range belongs to the task where it begins, and is held whole.
    """
    cuts = archives.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
    ranges = cuts.select("path", "bytes", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(place) as file:
                    out = []
                    for at, content in members(Window(file, row["bytes"]), row["start"], row["stop"]):
                        f = parse(content)
                        if f is None:
                            continue
                        digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
                        length = _number(f.get("warc-payload-length"))
                        if f.get("warc-type") != "revisit":
                            length, own = len(f["payload"]), hashlib.sha256(f["payload"]).hexdigest()
                            if digest and own != digest:
                                raise ValueError(f"payload digest of the record at {at} does not fit")
                            digest = own
                        out.append((_number(f.get("warc-page-id")), row["path"], at, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), _number(f.get("warc-refers-to-page-id")), length, digest, f["payload"] if payloads else None))
                        if len(out) == 500:
                            yield _records(out)
                            out = []
                    if out:
                        yield _records(out)

    # Ranges are rows of a few bytes, so their number and not their size says how many tasks read them.
    tasks = min(ranges.count(), READ_TASKS) or 1
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, "page_id long, " + RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "path", "start", "record_type", "record_id", "uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
