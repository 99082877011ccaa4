"""WARC archives: a writer with revisit records, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hint_small, materialize, new_path, open_fs, prepare_tasks

MAGIC = b"\x1f\x8b\x08"
#: What a record begins with, and the whole version line.
VERSION, VERSION_LINE = b"WARC/", re.compile(rb"WARC/[0-9]+\.[0-9]+[ \t]*\r?\n")
#: Compressed bytes that are decoded at first to see whether a member is a record.
PROBE = 512
CHUNK = 1 << 20
#: Bytes taken or decoded at once, and the longest header.
PIECE, HEAD = 1 << 16, 1 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hexadecimal SHA-1, five hex digits to four letters."""
    letters = []
    for i in range(8):
        part = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member: an HTTP response, of which a revisit holds the header only.

    Its id names the page and, unless others may refer to it, is made unique by a random part.
    """
    name = "null" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    unique = f":{uuid.uuid4().hex}" if revisit or page_id is None else ""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}:{digest}{unique}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write one record per row and return the manifest (path, n_records, n_bytes), itself a written table.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is a response and the others
    are revisits; smaller payloads are all responses. Null payloads count as empty. Null ids are largest. If the smallest id
    occurs more than once in a group, all its rows are responses (with one record id, for nothing tells them apart); of a group
    of null ids only, all rows are. Ids may be numbers or texts without white space. ``date`` is the records' WARC-Date, by
    default the present. Empty input writes nothing. Other columns are ignored.

    ``folder`` keeps the archives; without it they go to the scratch folder and are removed when the driver ends. Driver and
    tasks open it with pyarrow, so it must be a file system that pyarrow knows (a shared mount, HDFS, an object store).

    A task writes to a name of its own and the manifest is committed by Spark, so what a lost or doubled attempt leaves
    behind is not in the manifest and is never read.
    """
    spark = pages.sparkSession
    prepare_tasks(spark)
    folder, date = folder or new_path(spark, "warc"), date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload")).withColumn("_n", F.octet_length("payload"))
    groups = rows.where(F.col("_n") >= min_bytes).groupBy("_sha", "_n").agg(F.min("page_id").alias("_first"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    rows = rows.join(hint_small(materialize(groups, "warc-groups"), 96), ["_sha", "_n"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    rows = rows.select("page_id", "url", "payload", base32_of_hex(F.col("_sha")).alias("digest"), "_first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, first, again in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                size += out.write(record := record_bytes(page_id, url, payload.encode(), digest, first, again, date)) or len(record)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_records": [n], "n_bytes": [system.get_file_info(f"{root}/{path}").size]})

    return materialize(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


class _Window:
    """Reads a file forward from any offset, keeping no more than what is being decoded."""

    def __init__(self, handle):
        self.handle, self.start, self.data = handle, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if not (self.start <= offset and offset + n <= self.start + len(self.data)):
            self.handle.seek(offset)
            self.start, self.data = offset, self.handle.read(max(n, CHUNK))
        return self.data[offset - self.start : offset - self.start + n]


class _Stream:
    """The bytes from an offset on, decoded if ``packed``, to the end of the gzip member there or of the file."""

    def __init__(self, window: _Window, offset: int, packed: bool):
        self.window, self.at, self.inside, self.buffer, self.ended = window, offset, 0, b"", False
        self.decoder = zlib.decompressobj(31) if packed else None

    def fill(self) -> bool:
        """Get some more bytes; False if there are none. A member that is cut short is an error."""
        while not self.ended:
            data = self.window.at(self.at, PIECE)
            if self.decoder is None:
                self.at, self.ended = self.at + len(data), not data
            elif not data:
                raise ValueError("the member is cut short")
            else:
                packed, data = len(data), self.decoder.decompress(data, PIECE)
                self.ended = self.decoder.eof
                self.at += packed - len(self.decoder.unused_data if self.ended else self.decoder.unconsumed_tail)
            if data:
                self.buffer += data
                return True
        return False

    def skip_breaks(self) -> None:
        """Go past line breaks, of which two follow a record."""
        while True:
            rest = self.buffer.lstrip(b"\r\n")
            self.inside, self.buffer = self.inside + len(self.buffer) - len(rest), rest
            if rest or not self.fill():
                return

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n and self.fill():
            pass
        return self.buffer[:n]

    def until(self, mark: bytes, most: int) -> bytes | None:
        """The bytes before ``mark``, which is passed; None if it isn't among the next ``most``, and then nothing is passed."""
        seen = 0
        while (i := self.buffer.find(mark, max(0, seen - len(mark)), most)) < 0:
            seen = len(self.buffer)
            if seen >= most or not self.fill():
                return None
        found, self.buffer = self.buffer[:i], self.buffer[i + len(mark) :]
        self.inside += i + len(mark)
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, which must be there, piece by piece."""
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("no block of the stated length")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            self.inside, n = self.inside + len(piece), n - len(piece)
            yield piece

    @property
    def offset(self) -> int:
        """Where reading stands in a plain file."""
        return self.at - len(self.buffer)


def is_record(window: _Window, offset: int, packed: bool = True) -> bool:
    """Whether a record begins at ``offset``: the member there decodes to a version line, or one stands there at the start of a line."""
    if not packed:
        return VERSION_LINE.match(window.at(offset, 32)) is not None and (offset == 0 or window.at(offset - 1, 1) == b"\n")
    try:
        return VERSION_LINE.match(zlib.decompressobj(31).decompress(window.at(offset, PROBE), 32)) is not None
    except zlib.error:
        return False


def next_record(window: _Window, offset: int, end: int, packed: bool = True) -> int | None:
    """The first record that starts in [offset, end)."""
    mark = MAGIC if packed else VERSION
    while offset < end:
        data = window.at(offset, min(CHUNK, end - offset) + len(mark) - 1)
        i = data.find(mark)
        while i >= 0 and offset + i < end:
            if is_record(window, offset + i, packed):
                return offset + i
            data = window.at(offset, min(CHUNK, end - offset) + len(mark) - 1)
            i = data.find(mark, i + 1)
        offset += CHUNK
    return None


def header_fields(lines: bytes) -> dict[str, str]:
    """Fields by lower-case name; of a repeated one the first; a line that begins with white space goes on with the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            found, _, value = line.partition(":")
            name = found.strip().lower()
            fields.setdefault(name, value.strip())
    return fields


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isascii() and text.isdigit() else None


class Record(NamedTuple):
    fields: dict[str, str]
    payload: bytes | None
    length: int | None
    digest: str | None


def read_record(stream: _Stream, keep: bool) -> Record:
    """The record that begins where ``stream`` stands: header fields, its payload if it is to be kept, length and SHA-1 of it.

    The payload of an HTTP message is what follows its own header; of other records it is the whole block. Of a revisit there is
    none, and the length is that which its HTTP header says, if any. Blocks are read piece by piece.
    """
    head = stream.until(b"\r\n\r\n", HEAD)
    if head is None or not VERSION_LINE.match(head + b"\r\n"):
        raise ValueError("no record header")
    fields = header_fields(head)
    left, http, parts, size, sha = _number(fields.get("content-length")), None, [], 0, hashlib.sha1()
    if left is None:
        raise ValueError("no length")
    stands_at = stream.inside
    if fields.get("content-type", "").lower().startswith("application/http"):
        lines = stream.until(b"\r\n\r\n", min(left, HEAD))
        if lines is None:
            lines, left = b"".join(stream.pieces(left)), 0
        else:
            left -= stream.inside - stands_at
        http = header_fields(lines)
    for piece in stream.pieces(left):
        sha.update(piece)
        size += len(piece)
        if keep:
            parts.append(piece)
    if fields.get("warc-type", "").lower() == "revisit":
        return Record(fields, None, _number(http.get("content-length")) if http else None, None)
    return Record(fields, b"".join(parts) if keep else None, size, base64.b32encode(sha.digest()).decode())


FIELDS = "path string, offset long, end long, inside long, record_id string, url string, date string, record_type string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean"


def read_warc(files: DataFrame, split_bytes: int = 4 << 20, payload: bool = False, damaged: bool = False) -> DataFrame:
    """Records of the archives listed in ``files`` (path, n_bytes): one row each, with ``payload`` also the payload (null for revisits).

    Archives may come from any writer: names of header fields are matched without regard to case, and records of any type, with
    any ids and without digests, are read. payload_digest is the header's as base32 of SHA-1, or computed where there is none; of a
    revisit without one it is null. ``digest_ok`` tells whether the payload has the digest its header says; it is null for
    revisits and where the header has none, or one of another kind, which is then given as it stands.

    Each task has a byte range. It looks for gzip magic, takes a member for a record if its first bytes decode to a WARC version
    line, and owns the members that start inside its range, reading past its end where a member does. All records of a member are
    read, one after the other, so an archive packed as a whole is right, if in one task; ``inside`` is a record's place in what its
    member decodes to. A file that begins with a version line is plain: there, version lines at the start of a line are looked for
    instead. A range that begins inside a stored payload might take an archive quoted there for records: such rows lie before
    the end of a record found in an earlier range, and are removed by the furthest end of each range, a small table.

    With ``damaged``, all bytes that belong to no record are rows of that type too, each run of them with its offset and end, and what
    is left of a member behind records that could be read; without, they are passed over. No files give no rows.
    """
    spark = files.sparkSession
    prepare_tasks(spark)
    schema = f"part long, {FIELDS}" + (", payload binary" if payload else "")
    ranges = files.where("n_bytes > 0").select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )

    def rows_of(path: str, size: int, start: int) -> Iterator[list]:
        def unread(offset: int, until: int, inside: int) -> list:
            return [start, path, offset, until, inside, None, None, None, "damaged", None, None, None, None] + [None] * payload

        system, name = open_fs(path)
        end, reach = min(size, start + split_bytes), None
        with system.open_input_file(name) as handle:
            window = _Window(handle)
            packed = window.at(0, len(VERSION)) != VERSION
            at = next_record(window, start, end, packed)
            while at is not None and at < end:
                stream, n = _Stream(window, at, packed), 0
                try:
                    while True:
                        stands_at = stream.inside
                        record = read_record(stream, payload)
                        stream.skip_breaks()
                        if not n and reach is not None and at > reach:
                            yield unread(reach, at, 0)
                        fields, n, reach = record.fields, n + 1, stream.at if packed else stream.offset
                        digest = fields.get("warc-payload-digest")
                        kind, _, stated = digest.partition(":") if digest else ("", "", "")
                        known = kind.lower() == "sha1" and len(stated) == 32
                        shown = stated.upper() if known else digest or record.digest
                        yield [
                            start, path, at, reach, stands_at, fields.get("warc-record-id", "").strip("<>") or None, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-type", "").lower(),
                            fields.get("warc-refers-to", "").strip("<>") or None, shown, record.length, stated.upper() == record.digest if known and record.digest else None,
                        ] + [record.payload] * payload
                        if not packed or not stream.peek(1):
                            break
                except (zlib.error, ValueError):
                    if n:  # what is behind the last record of this member
                        yield unread(at, reach, stands_at)
                    at = next_record(window, at + 1, end, packed)
                    continue
                at = reach if is_record(window, reach, packed) else next_record(window, reach, end, packed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([pa.field(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])
        rows, held = [], 0
        for batch in batches:
            for where in zip(*(c.to_pylist() for c in batch.columns)):
                for row in rows_of(*where):
                    rows.append(row)
                    held += 300 + (len(row[-1] or b"") if payload else 0)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    total = files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # A task has about one range, so that one which is lost costs little.
    found = materialize(ranges.repartition(max(1, -(-total // split_bytes)), "path", "start").mapInArrow(scan, schema), "warc-records")
    per = found.groupBy("path", "part").agg(F.max("end").alias("_end"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = materialize(per.select("path", "part", F.max("_end").over(before).alias("_above")), "warc-ends")
    owned = found.join(hint_small(per, 24, "path"), ["path", "part"]).where(F.col("_above").isNull() | (F.col("offset") >= F.col("_above")))
    if not damaged:
        return owned.where("record_type <> 'damaged'").drop("part", "_above")
    # Between ranges, before the first record, behind the last and in files without any: from a row for each range.
    reach = materialize(owned.groupBy("path", "part").agg(F.min("offset").alias("_first"), F.max("end").alias("_last")), "warc-reach")
    heads = reach.select("path", F.coalesce(F.max("_last").over(before), F.lit(0)).alias("offset"), F.col("_first").alias("end"))
    last = reach.groupBy("path").agg(F.max("_last").alias("_last"))
    tails = files.select("path", "n_bytes").join(last, "path", "left").select("path", F.coalesce("_last", F.lit(0)).alias("offset"), F.col("n_bytes").alias("end"))
    gaps = heads.unionByName(tails).where("offset < end").select("path", "offset", "end", F.lit(0).cast("long").alias("inside"), F.lit("damaged").alias("record_type"))
    return owned.drop("part", "_above").unionByName(gaps, allowMissingColumns=True)


def page_of(urn: Column) -> Column:
    """The page id in the record ids that ``write_warc`` gives; null for others and for a null id."""
    return F.regexp_extract(urn, r"^urn:page:([^:]+):", 1).try_cast("long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written and read back. Null html is an empty payload, and empty payloads revisit each other; a page
    whose id is null has a record with a null page_id."""
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    page, first = page_of(F.col("record_id")).alias("page_id"), page_of(F.col("refers_to")).alias("refers_to")
    ok = F.coalesce("digest_ok", F.lit(True)).alias("digest_ok")
    return read_warc(manifest).select(page, "payload_bytes", "payload_digest", "record_type", first, ok)


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h, octet_length(encode(payload))) AS first FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS digest_ok
FROM q
"""
