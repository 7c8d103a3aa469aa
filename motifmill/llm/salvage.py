"""WARC archives of web pages, written as gzip members or plain, and a reader that salvages damaged ones.

Writing: records of equal payloads are one response and revisits of it. Spark's text writer puts the
records into files, so that commits and retries are Spark's own. Reading: each file is scanned from its start. Where
a member or record fails a check, the reader looks for the next place where one begins and passes all
checks, takes up from there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifmill.llm.shared import in_arrow, new_path, save

#: Records in a file at most, which bounds what a reader's task holds.
FILE_RECORDS = 5000
#: Payloads of at least so many bytes are written once.
LEAST_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
END = b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")


def member(data: bytes, level: int = 6) -> bytes:
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A record with its end; a revisit has the header of the HTTP response and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    name = lambda i: f"<{PAGE}{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


@dataclass
class Found:
    """A record or a gap. offset and length are of the file's bytes: those of a record's whole member, if it has one."""

    kind: str
    offset: int
    length: int
    inner: int = 0
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes | None:
        """What follows the block's HTTP header; None for revisits, the whole block where there is no HTTP header."""
        if self.headers.get("warc-type") == "revisit":
            return None
        if not self.headers.get("content-type", "").startswith("application/http"):
            return self.block
        return self.block.partition(END)[2]

    def payload_bytes(self) -> int | None:
        """Of a response as it is, of a revisit as the kept HTTP header says."""
        if (p := self.payload) is not None:
            return len(p)
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", self.block.partition(END)[0])
        return int(m[1]) if m else None


def _broken(headers: dict[str, str], found: Found) -> str | None:
    for name, data in (("warc-block-digest", found.block), ("warc-payload-digest", found.payload)):
        algorithm, _, want = headers.get(name, "").partition(":")
        if algorithm.lower() == "sha1" and data is not None and digest(data) != want.strip().upper():
            return f"{name} differs"
    return None


def parsed(data: bytes, at: int) -> tuple[Found, int] | str:
    """The record that begins at a place and the place after it, or why there is none that passes all checks."""
    m = VERSION.match(data, at)
    if not m:
        return "no version line"
    end = data.find(END, m.end() - 2)
    if end < 0:
        return "headers don't end"
    headers: dict[str, str] = {}
    last = ""
    for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n") if end > m.end() else ():
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return "a header without a name"
        last = name.strip().lower()
        headers[last] = value.strip()
    if not re.fullmatch("[0-9]+", headers.get("content-length", "")) or not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        return "a header that every record has is missing"
    first = end + len(END)
    after = first + int(headers["content-length"])
    if data[after : after + len(END)] != END:
        return "the record doesn't end after its length"
    found = Found("record", at, after + len(END) - at, headers=headers, block=data[first:after])
    return _broken(headers, found) or (found, after + len(END))


def plain(data: bytes) -> Iterator[Found]:
    """All records of bytes that aren't packed, and the gaps between them: every byte is in one of both."""
    return scanned(data, packed=False)


def _inflated(data: bytes, at: int) -> tuple[bytes, int | None, str | None]:
    """What the member at a place unpacks to, the place after it (None if it fails), and why it fails."""
    if data[at : at + 3] != MAGIC:
        return b"", None, "no member"
    unpack, out, view = zlib.decompressobj(31), [], memoryview(data)
    step = 1 << 16
    for i in range(at, len(data), step):
        try:
            out.append(unpack.decompress(view[i : i + step]))
        except zlib.error as e:
            return b"".join(out), None, f"member: {e}"[:80]
        if unpack.eof:
            return b"".join(out), min(i + step, len(data)) - len(unpack.unused_data), None
    return b"".join(out), None, "member: cut off"


def _beginning(data: bytes, at: int, packed: bool) -> tuple[list[Found], int] | str:
    """The records of what begins at a place, if it passes its checks, and the place after it; else why it doesn't."""
    if packed and data[at : at + 3] == MAGIC:
        unpacked, after, why = _inflated(data, at)
        if after is None:
            return why
        return [Found(f.kind, at, after - at, f.offset, f.reason, f.headers, f.block) for f in plain(unpacked)], after
    got = parsed(data, at)
    return got if isinstance(got, str) else ([got[0]], got[1])


def _next(data: bytes, at: int, packed: bool) -> int:
    """The first place from `at` on where a member or record begins that passes its checks; the end if none does."""
    line, mark = -1, -1
    while at < len(data):
        if line < at:
            m = VERSION.search(data, at)
            line = m.start() if m else len(data)
        if mark < at:
            mark = data.find(MAGIC, at) if packed else len(data)
            mark = len(data) if mark < 0 else mark
        at = min(line, mark)
        if at < len(data) and not isinstance(_beginning(data, at, packed), str):
            break
        at += 1
    return min(at, len(data))


def scanned(data: bytes, packed: bool = True) -> Iterator[Found]:
    """All records of an archive's bytes, and the gaps: members and records that fail, bytes between them, and parts of good members that are no records.

    Files may have members, plain records or both. Records that a broken member unpacks to whole before it
    breaks are recovered too; the gap begins with that member all the same. Gaps within a good member have its place
    and their own place in what it unpacks to (inner).
    """
    at = 0
    while at < len(data):
        got = _beginning(data, at, packed)
        if not isinstance(got, str):
            yield from got[0]
            at = got[1]
            continue
        begin, at = at, _next(data, at + 1, packed)
        if packed and data[begin : begin + 3] == MAGIC:
            for f in plain(_inflated(data, begin)[0]):
                if f.kind == "record":
                    yield Found(f.kind, begin, at - begin, f.offset, None, f.headers, f.block)
        yield Found("gap", begin, at - begin, reason=got)


SCHEMA = "file string, kind string, offset long, length long, inner long, reason string, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
#: Payload bytes that a batch of results has, about.
OUT_BYTES = 4 << 20


def _scan(payloads: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                name = path.as_py()
                for f in scanned(content.as_py() or b""):
                    h = f.headers
                    is_record = f.kind == "record"
                    ident = lambda key: h[key].strip("<>") if key in h else None  # noqa: B023, E731
                    p = f.payload if payloads and is_record else None
                    rows.append((
                        name, f.kind, f.offset, f.length, f.inner, f.reason, h.get("warc-type"), ident("warc-record-id"), ident("warc-refers-to"), h.get("warc-target-uri"),
                        h.get("warc-payload-digest", "").rpartition(":")[2] or (digest(f.payload) if is_record and f.payload is not None else None), f.payload_bytes() if is_record else None, p,
                    ))
                    held += len(p or b"") + 200
                    if held > OUT_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """Every record and gap of the archives in a folder; columns as SCHEMA.

    kind is "record" or "gap". Of gzip files a record's offset and length are those of its member, inner its place in
    what the member unpacks to; plain files have inner 0. A record passes all its checks: version line,
    headers that every record has, length, end, and block and payload digests where it has SHA-1 ones; other bytes are in gaps,
    whose reason is the check that failed first. Each file is scanned by one task that holds it whole (2 GB at most, and
    the largest record of a gzip file unpacked); lost executors mean their files are scanned again. Files
    without bytes give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return in_arrow(files, _scan(payloads), SCHEMA)


def records(scan: DataFrame) -> DataFrame:
    return scan.where("kind = 'record'")


def gaps(scan: DataFrame) -> DataFrame:
    """The log of quarantined bytes: file, offset, length, inner, reason."""
    return scan.where("kind = 'gap'").select("file", "offset", "length", "inner", "reason")


def _records(packed: bool):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")))
            out = []
            for page, url, html, refers_to in rows:
                r = record("response" if refers_to is None else "revisit", page, url, (html or "").encode(), refers_to)
                out.append(member(r) if packed else r[: -len(END)])
            values = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(values), values.buffers())], ["value"])

    return run


def referring(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id of the rows with an equal payload; null for rows that have it themselves.

    Payloads of fewer than `least` bytes refer to none. A null html is empty. Rows that repeat the largest
    page_id are all responses; of equal payloads without any page_id all are, too. Payloads are told apart by SHA-256. Only
    payloads of two pages or more are joined with, from a written table, so that Spark sends it to all
    executors where it is small enough for its own limit and else joins by shuffles whose hot payloads it splits.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.when(F.octet_length(html) >= least, F.unhex(F.sha2(html, 256))).alias("sha"))
    several = p.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).where("n > 1 and last_id is not null")
    several = save(several.select("sha", "last_id"), "several")
    return p.join(several, "sha", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last_id")), F.col("last_id")).alias("refers_to"))


def write(pages: DataFrame, path: str, packed: bool = True, least: int = LEAST_REVISIT, file_records: int = FILE_RECORDS) -> None:
    """Archives of (page_id, url, html) in a new folder: one gzip member for each record, or plain.

    The text writer ends each value with a separator: between members an empty member, which unpacks to
    nothing, and in plain files the end of a record. A file has file_records records at most. Characters that a header can't have
    are escaped in urls. Null urls are left out, null page_ids empty. No pages give no records. Other columns are
    not written.
    """
    rows = in_arrow(referring(pages, least), _records(packed), "value string")
    separator = member(b"").decode("latin-1") if packed else END.decode()
    rows.write.option("maxRecordsPerFile", file_records).option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)


def round_trip(pages: DataFrame, packed: bool = True) -> DataFrame:
    """What archives of all pages in the shared folder give back: page_id, payload_bytes, payload_digest, record_type, refers_to, url; a row for each page."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, packed)
    back = records(read(pages.sparkSession, path, payloads=False))
    number = lambda c: F.nullif(F.regexp_replace(c, f"^{PAGE}", ""), F.lit("")).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url")
