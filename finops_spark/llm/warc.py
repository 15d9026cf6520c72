"""WARC archives: writing pages as records, and a sequential reader.

Every record is a gzip member of its own. The reader inflates an archive step by step with
zlib, takes each record's head up to the empty line, then exactly Content-Length bytes of
block, hashing as they come, and compares the digests with those in the head.

Archives are written by Spark's text sink, so they can lie in any store that Spark writes,
with its protocol for lost and repeated tasks. The sink ends each row with a separator: a
member's last byte is 0 (the top byte of its length, below 16 MiB), so rows leave it out
and the separator puts it back.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import store
from finops_spark.session import shared_folder

#: Payloads below so many bytes are always stored in full.
LEAST_REVISIT = 100
#: Bytes of payload for each archive, about; one archive is read by one task.
ARCHIVE_BYTES = 32 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has no payload but its length and digest."""
    block = _HTTP if revisit else _HTTP + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    packed = gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)
    return packed if packed.endswith(b"\0") else packed + _EMPTY_MEMBER


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, first): for every distinct payload of a page that others have, too, its digest
    and the smallest page_id with this payload; only payloads of at least ``least`` bytes.

    Shorter payloads stay where they are. The smallest id of each digest is found with partial sums and
    written, so that the other side of the join is a plain scan and a common digest can be split."""
    long = pages.where(F.octet_length("html") >= least).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    firsts = long.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = store(firsts.where("n > 1").select("_digest", "first"), "first-payloads")
    return long.join(firsts, F.col("digest") == F.col("_digest")).select("page_id", "digest", "first").distinct()


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT) -> str:
    """Write a record for each row of (page_id, url, html); returns the folder of the archives.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is a
    response, the others revisit it. NULL html is an empty payload; a NULL page_id is kept
    and is first only where no page of the payload has an id; repeated rows of one page are
    repeated records of the same type."""
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length("html"))).head()[0] or 0
    parts = max(1, -(-total // ARCHIVE_BYTES), spark.sparkContext.defaultParallelism if total > ARCHIVE_BYTES else 1)
    # no fewer than Spark deals out itself, or the join would deal anew; then put together without moving
    deal = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a key without NULLs, and both sides dealt alike, so that the join takes the rows as they have been dealt out
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_key")
    kinds = decide(pages, least).select(key, "digest", "first").repartition(deal, "_key", "digest")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(key, "page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    ready = rows.repartition(deal, "_key", "digest").join(kinds, ["_key", "digest"], "left").select("page_id", "url", "html", "digest", "first").coalesce(parts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = []
            for r in batch.to_pylist():
                revisit = r["first"] is not None and r["first"] != r["page_id"]
                members.append(member(r["page_id"], r["url"], r["html"], r["digest"], r["first"], revisit)[:-1])
            yield pa.RecordBatch.from_pydict({"record": pa.array(members, pa.binary())})

    folder = shared_folder(spark, "warc")
    ready.mapInArrow(packed, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)
    return folder


class ArchiveReader:
    """The records of one archive in order; ``step`` bytes are inflated at a time."""

    def __init__(self, data: bytes | memoryview, step: int = 1 << 16):
        self.data, self.step = memoryview(data), step

    def _inflated(self) -> Iterator[bytes | None]:
        """Pieces of the inflated members, None at the end of each."""
        rest = self.data
        while len(rest):
            stream, fed = zlib.decompressobj(wbits=31), 0
            while not stream.eof:
                if fed >= len(rest):
                    raise ValueError("archive ends within a record")
                yield stream.decompress(rest[fed : fed + self.step])
                fed += self.step
            rest = rest[min(fed, len(rest)) - len(stream.unused_data) :]
            yield None

    def records(self) -> Iterator[dict]:
        """type, page_id, refers_to, payload_bytes, payload_digest, digest_ok of each record."""
        record = _Record()
        for piece in self._inflated():
            if piece is not None:
                record.feed(piece)
            elif record.started:
                yield record.finish()
                record = _Record()


class _Record:
    """One record while it is read: head, then the HTTP head, then the payload, of which only digests are kept."""

    def __init__(self):
        self.held, self.head, self.left, self.http = b"", None, 0, True
        self.block, self.payload, self.size, self.started = hashlib.sha256(), hashlib.sha256(), 0, False

    def feed(self, piece: bytes) -> None:
        self.started = self.started or bool(piece)
        if self.head is None:
            self.held += piece
            at = self.held.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = self.held[:at].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record here")
            self.head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
            self.left = int(self.head["content-length"])
            piece, self.held = self.held[at + 4 :], b""
        part = piece[: self.left]
        self.left -= len(part)
        self.block.update(part)
        if self.http:
            self.held += part
            if (at := self.held.find(b"\r\n\r\n")) < 0:
                return
            self.http, part, self.held = False, self.held[at + 4 :], b""
        self.payload.update(part)
        self.size += len(part)

    def finish(self) -> dict:
        if self.head is None or self.left:
            raise ValueError("record is shorter than its Content-Length")
        head = self.head
        revisit = head["warc-type"] == "revisit"
        said = head["warc-payload-digest"].removeprefix("sha256:")
        ok = head["warc-block-digest"] == f"sha256:{self.block.hexdigest()}" and (revisit or said == self.payload.hexdigest())
        return {
            "page_id": page_of(head["warc-record-id"]),
            "payload_bytes": int(head["x-payload-length"]) if revisit else self.size,
            "payload_digest": said if revisit else self.payload.hexdigest(),
            "record_type": head["warc-type"],
            "refers_to": page_of(head["warc-refers-to"]) if revisit else None,
            "digest_ok": ok,
        }


def read_archives(spark, folder: str) -> DataFrame:
    """One row for each record of the archives in a folder: page_id, payload_bytes, payload_digest,
    record_type, refers_to, digest_ok. For a revisit, length and digest are those it states of the payload
    it stands for; ``with_checked_revisits`` compares them with its response. A broken archive raises; a record whose content does not match its digests has
    digest_ok false."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                for record in ArchiveReader(content.as_buffer()).records():
                    rows.append(record)
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(opened, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, digest_ok boolean")


def with_checked_revisits(records: DataFrame) -> DataFrame:
    """The records with digest_ok false for revisits whose length and digest are not those of an intact
    response named by refers_to. ``records`` is read three times, so it should be a stored table.

    What revisits claim is made distinct first, so a response with very many revisits is one row; only
    wrong claims, none in a sound archive, go back to the rows."""
    claim = ["refers_to", "payload_bytes", "payload_digest"]
    claims = records.where("record_type = 'revisit'").select(*claim).distinct()
    sound = records.where("record_type = 'response' and digest_ok").select(F.col("page_id").alias("refers_to"), *claim[1:])
    wrong = store(claims.join(sound, claim, "left_anti").select(*[F.col(c).alias(f"_{c}") for c in claim], F.lit(True).alias("_wrong")), "wrong-revisits")
    same = F.col("record_type") == "revisit"
    for c in claim:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = records.join(wrong, same, "left")
    return joined.select(*[(F.col("digest_ok") & F.col("_wrong").isNull()).alias(c) if c == "digest_ok" else c for c in records.columns])


def archive_report(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as archives and read them back, a row for each record; see ``write_archives``.

    An empty table gives no record; columns other than page_id, url and html are ignored."""
    return with_checked_revisits(store(read_archives(pages.sparkSession, write_archives(pages, least)), "archive-records"))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to,
       true AS digest_ok
FROM f
"""
