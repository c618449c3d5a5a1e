"""WARC archives: writing with revisit records for repeated payloads, and a reader that salvages damaged archives.

An archive is a byte string of WARC/1.1 records, each a gzip member of its own (or all plain). Archives are rows of a
table in the shared folder, so any store that Spark writes will do; `write_files` lays them out as files where a local
or mounted folder is wanted.

The reader checks what it can: the member's checksum and length, the version line, the header, the block's length and
end, and the payload's digest. After a failed check it searches for the next valid member, or the next version line,
goes on there, and logs the bytes between as quarantined. A member may hold any number of records, and is searched in the
same way; of a member that is damaged, cut short or too large, the records before the damage are kept if their own
digests prove them. `resolved` checks revisits against the records they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import tidy
from .common import bounded_batches, materialize
from .words import chunks, utf8

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that a member may hold once decompressed; what lies beyond is quarantined.
MEMBER_BYTES = 1 << 28
#: Bytes of records up to which a task fills one archive.
ARCHIVE_BYTES = 16 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int, digest: str) -> str:
    """Of a page with its payload: a page_id may come with several."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record with an HTTP block, or, with ``refers_to``, a revisit record that has its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\s\x00-\x1f]", "", url or "") or "about:blank"
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {page_id}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Salvage:
    """What an archive yields: records as (offset, header, payload) and gaps as (start, end, why)."""

    records: list = field(default_factory=list)
    gaps: list = field(default_factory=list)


def _parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: header, block, and where it ends. ValueError says which check failed."""
    line = data.find(b"\r\n", at, at + 20)
    if line < 0 or not re.fullmatch(rb"WARC/\d+\.\d+", data[at:line]):
        raise ValueError("version line")
    end = data.find(b"\r\n\r\n", line)
    if end < 0:
        raise ValueError("header end")
    header: dict[str, str] = {}
    for row in data[line + 2 : end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError("header line")
        header[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    if not header.get("content-length", "").isdecimal() or not {"warc-type", "warc-record-id"} <= header.keys():
        raise ValueError("required field")
    start = end + 4
    stop = start + int(header["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    return header, data[start:stop], stop + 4


def _payload(header: dict[str, str], block: bytes) -> bytes:
    """The payload, checked against its digest where the record holds one."""
    if header["warc-type"] == "revisit":
        return b""
    _, _, payload = block.partition(b"\r\n\r\n")
    kind, _, digest = header.get("warc-payload-digest", "").partition(":")
    if kind == "sha1" and digest != payload_digest(payload):
        raise ValueError("payload digest")
    return payload


def _member(data: bytes, at: int, most: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at`` as far as it can be had, where it ends, and what is wrong with it ("":
    nothing, its checksum is verified)."""
    z, out, end, size = zlib.decompressobj(31), [], at, 0
    try:
        while not z.eof and end < len(data) and size <= most:
            feed = z.unconsumed_tail or data[end : end + 65536]
            end += 0 if z.unconsumed_tail else len(feed)
            out.append(z.decompress(feed, 1 << 20))
            size += len(out[-1])
        while not z.eof and z.unconsumed_tail and size <= most:
            out.append(z.decompress(z.unconsumed_tail, 1 << 20))
            size += len(out[-1])
    except zlib.error as e:
        return b"".join(out), end, f"member: {e}"
    if not z.eof:
        return b"".join(out), end, "member: too large" if size > most else "member: cut short"
    return b"".join(out), end - len(z.unused_data), ""


class _Log:
    """Gaps in the making: from the first failure to the next valid record."""

    def __init__(self, out: Salvage):
        self.out, self.bad, self.why = out, None, ""

    def failed(self, place: int, reason: str) -> None:
        if self.bad is None:
            self.bad, self.why = place, reason

    def fine(self, place: int) -> None:
        if self.bad is not None:
            self.out.gaps.append((self.bad, place, self.why))
            self.bad = None


def _records(data: bytes, magic: bool) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(start, end, header, payload, "") of each valid record of plain bytes, and (start, end, None, b"", why) of what lies
    between. ``magic``: a gzip member may begin too; it ends the plain bytes."""
    at = 0
    while at < len(data):
        if magic and data.startswith(MAGIC, at):
            return
        try:
            header, block, end = _parse(data, at)
            payload = _payload(header, block)
        except ValueError as e:
            found = [x for x in (data.find(b"WARC/", at + 1), data.find(MAGIC, at + 1) if magic else -1) if x >= 0]
            end = min(found, default=len(data))
            yield at, end, None, b"", str(e)
        else:
            yield at, end, header, payload, ""
        at = end


def _proven(header: dict[str, str]) -> bool:
    """Whether a record holds a digest, which was checked, of a payload that it has."""
    return header["warc-type"] != "revisit" and header.get("warc-payload-digest", "").startswith("sha1:")


def read_archive(data: bytes, most: int = MEMBER_BYTES) -> Salvage:
    """Every record that passes its checks, in order, and the gaps between them, in bytes of the archive; what is wrong
    inside a member is a gap of the whole member. Never fails."""
    out = Salvage()
    log, at = _Log(out), 0
    while at < len(data):
        if not data.startswith(MAGIC, at):
            start = at
            for lo, hi, header, payload, why in _records(data[start:] if start else data, magic=True):
                at = start + hi
                if header is None:
                    log.failed(start + lo, why)
                else:
                    log.fine(start + lo)
                    out.records.append((start + lo, header, payload))
            continue
        content, end, wrong = _member(data, at, most)
        inside = list(_records(content, magic=False))
        good = [r for r in inside if r[2] is not None and (not wrong or _proven(r[2]))]
        if not wrong and not good and not content:
            log.fine(at)
            at = end
            continue
        if good:
            log.fine(at)
            out.records += [(at, r[2], r[3]) for r in good]
        why = wrong or next((r[4] for r in inside if r[2] is None), "")
        if not why:
            at = end
            continue
        log.failed(at, why)
        if not wrong:  # the member's end is known
            log.fine(end)
            at = end
            continue
        # what a member gave up is not looked for again in its bytes: only the next member is
        found = [x for x in (data.find(MAGIC, at + 1), -1 if good else data.find(b"WARC/", at + 1)) if x >= 0]
        at = min(found, default=len(data))
    log.fine(len(data))
    return out


def payload_plan(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, digest, size, refers_to): each page with each of its payloads, and for all but the smallest identifier of equal
    payloads that smallest one.

    Payloads meet as SHA-1 and length; each group's smallest is found with partial sums, so a payload in a third of all
    rows is no hot spot."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    slim = materialize(pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size")), "payload-digests")
    several = slim.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "size", "first")
    several = materialize(several, "repeated-payloads")
    return slim.join(several, ["digest", "size"]).where("id <> first").select("id", "digest", "size", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", compress: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive string, data binary): all pages as WARC archives, in a table of the shared folder.

    A null payload is empty. Rows without an identifier are left out, for a record needs one. Every row is a record: rows
    that repeat an identifier with the same payload are of one type, and with other payloads each is planned by its own."""
    bounded_batches(pages.sparkSession)
    pages = pages.where(F.col(id_col).isNotNull())
    plan = payload_plan(pages, id_col, payload_col)
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(payload_col).cast("string").alias("text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("digest", F.sha1(body)).withColumn("size", F.octet_length(body))
    rows = rows.join(plan, ["id", "digest", "size"], "left").select("id", "url", "text", "refers_to")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for nth, t in enumerate(chunks(batches, "text", archive_bytes)):
            parts = []
            for i, u, body, to in zip(t["id"].to_pylist(), t["url"].to_pylist(), utf8(t["text"]), t["refers_to"].to_pylist(), strict=True):
                record = make_record(i, u, body, payload_digest(body), to)
                parts.append(gzip_member(record) if compress else record)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{nth:06d}"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "data"])

    return materialize(rows.mapInArrow(tidy(run), "archive string, data binary"), "warc")


RECORDS = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def whole_number(value: str | None) -> int | None:
    """A header's whole number, or None: other writers may use the name for something else."""
    return int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per salvaged record of (archive, data) rows; of a revisit, bytes and digest are those of the full
    payload, as its header says (see ``resolved``). Numbers in headers that are none are null. A null archive has no records.
    ``with_payload``: the payload as well."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for at, h, payload in read_archive(data.as_py() or b"").records:
                    to, size = whole_number(h.get("warc-refers-to-page-id")), whole_number(h.get("warc-payload-length"))
                    revisit = h["warc-type"] == "revisit"
                    rows.append(
                        (
                            name, at, whole_number(h.get("warc-page-id")),
                            size if revisit and size is not None else len(payload),
                            h.get("warc-payload-digest", "").removeprefix("sha1:") or payload_digest(payload),
                            h["warc-type"], to, h.get("warc-target-uri"), payload if with_payload else None,
                        )
                    )
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = [x.split()[0] for x in RECORDS.split(", ")]
                for lo in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[lo : lo + 1024]], k) for i, k in enumerate(kinds)], names)

    out = archives.select(F.col("archive").cast("string").alias("archive"), F.col("data").cast("binary").alias("data")).mapInArrow(tidy(run), RECORDS)
    return out if with_payload else out.drop("payload")


def resolved(records: DataFrame) -> DataFrame:
    """Records with a column ``resolved``: whether a revisit's page, digest and length are those of a response that was read;
    true of all other records."""
    of = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct().withColumn("there", F.lit(True))
    out = records.join(of, ["refers_to", "payload_digest", "payload_bytes"], "left")
    return out.select(*records.columns, (F.col("there").isNotNull() | (F.col("record_type") != "revisit")).alias("resolved"))


def quarantine(archives: DataFrame) -> DataFrame:
    """(archive, start, end, reason): the byte gaps that held no valid record."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(n, *g) for n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for g in read_archive(d or b"").gaps]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.string(), pa.int64(), pa.int64(), pa.string()])], ["archive", "start", "end", "reason"])

    return archives.select(F.col("archive").cast("string").alias("archive"), F.col("data").cast("binary").alias("data")).mapInArrow(tidy(run), "archive string, start long, end long, reason string")


def write_files(archives: DataFrame, folder: str) -> list[str]:
    """The archives as .warc.gz files in a folder of this machine, one at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    out = []
    for name, data in archives.select("archive", "data").toLocalIterator():
        out.append(f"{folder}/{name}.warc.gz")
        with open(out[-1], "wb") as f:
            f.write(data)
    return out


def read_files(spark, path: str) -> DataFrame:
    """(archive, data) of WARC files in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))
