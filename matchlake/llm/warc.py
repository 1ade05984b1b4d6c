"""WARC archives of pages: written with an index, read back through the index by ranges of bytes.

A page becomes a record of its own gzip member, so a record can be read alone. Tasks compress the
records where they read the pages; what is then shuffled, by digest, is compressed. Of records with
equal payloads of ``revisit_bytes`` or more, those of the smallest page_id are written whole and the others as
revisits of it, which carry the HTTP header but no payload. While a task writes an archive it yields
the place, length, address and digest of each record; that index is a table, and every reader starts
from it: it selects records there, sorts their ranges by archive and offset, reads ranges that lie
close together at once, and checks each payload against its digest. ``index_archives`` makes the
index of archives from elsewhere, gzip by record or plain, reading each as a stream.

An archive gets a new name for each attempt of a task, and a reader knows only what the index
lists, so a failed, repeated or speculative task leaves nothing in the result; ``drop_unlisted``
removes its files. Archives are written and read through the file systems that pyarrow knows.

Defined cases: a null html is an empty payload, a null url an empty one, and blanks and control characters of an address are
percent-encoded in the record. Rows that share the smallest page_id and the payload are all written whole. A null
page_id counts as larger than any other; where all are null, all are whole. Other columns are left
out. An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import located
from .common import written

INDEX = "archive string, offset long, length long, kind string, record_id string, url string, digest string"
RECORD = "archive string, offset long, kind string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"
#: The profile that the format names for a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcRules:
    revisit_bytes: int = 100
    #: A task begins a new archive beyond so many bytes.
    archive_bytes: int = 1 << 30
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6
    #: Ranges are read together if at most ``gap`` bytes lie between them and all is at most ``span`` bytes.
    gap: int = 64 << 10
    span: int = 4 << 20
    #: Bytes of records that a reading task is given.
    task_bytes: int = 64 << 20


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _member(kind: str, page_id: int | None, url: str, digest: str, size: int, payload: bytes | None, rules: WarcRules, refers_to: int | None = None) -> bytes:
    """A record as a gzip member; without a payload it is a revisit."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {rules.date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[^\x21-\x7e]", lambda m: quote(m[0]), url))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Refers-To-Date: {rules.date}"]
    packer = zlib.compressobj(rules.level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _compressed(pages: DataFrame, rules: WarcRules) -> DataFrame:
    """(page_id, url, size, digest, member): each page as a whole record."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for page_id, url, html in zip(*batch.columns, strict=True):
                page_id, url, payload = page_id.as_py(), url.as_py() or "", (html.as_py() or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((page_id, url, len(payload), digest, _member("response", page_id, url, digest, len(payload), payload, rules)))
                held += len(rows[-1][-1]) + 200
                if held > 4 << 20:
                    yield _batch(rows, names, types)
                    rows, held = [], 0
            yield _batch(rows, names, types)

    names, types = ["page_id", "url", "size", "digest", "member"], [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(pack, "page_id long, url string, size long, digest string, member binary")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def write_archives(pages: DataFrame, folder: str, rules: WarcRules = WarcRules()) -> DataFrame:
    """Writes the pages (page_id, url, html) as archives into a folder of their own; the index of what was written, as a table."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digests = pages.where(F.octet_length(html) >= rules.revisit_bytes).select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"))
    kept = digests.groupBy("digest").agg(F.min("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = located(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, size, digest, member, keeper in zip(*batch.columns, strict=True):
                    page_id, url, digest, keeper, kind, data = page_id.as_py(), url.as_py(), digest.as_py(), keeper.as_py(), "response", member.as_py()
                    if keeper is not None and keeper != page_id:
                        kind, data = "revisit", _member("revisit", page_id, url, digest, size.as_py(), None, rules, keeper)
                    if out is None or at + len(data) > rules.archive_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(place, recursive=True)
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{place}/{name}", compression=None)
                    out.write(data)
                    rows.append((f"{folder.rstrip('/')}/{name}", at, len(data), kind, record_name(page_id), url, digest))
                    at += len(data)
                yield _batch(rows, *_INDEX)
        finally:
            if out is not None:
                out.close()

    return written(_compressed(pages, rules).join(kept, "digest", "left").select("page_id", "url", "size", "digest", "member", "kept").mapInArrow(write, INDEX))


_INDEX = (["archive", "offset", "length", "kind", "record_id", "url", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()])


def drop_unlisted(index: DataFrame, folder: str) -> int:
    """Deletes the archives of a folder that its index doesn't list, which are those of failed attempts; how many there were."""
    store, place = located(folder)
    listed = {located(r["archive"])[1] for r in index.select("archive").distinct().collect()}
    import pyarrow.fs as fs

    lost = [f.path for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.path not in listed and f.base_name.startswith("pages-")]
    for path in lost:
        store.delete_file(path)
    return len(lost)


def _fields(raw: bytes) -> tuple[dict[str, str], int]:
    """The fields of a WARC or HTTP header by lower-case name, and where what follows it begins."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[: end if end >= 0 else len(raw)].decode("utf-8", "replace").split("\r\n")
    found = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if colon:
            found[key.strip().lower()] = value.strip()
    return found, (end + 4 if end >= 0 else len(raw))


def _digest(fields: dict[str, str]) -> str:
    return fields.get("warc-payload-digest", "").rpartition(":")[2]


def index_archives(spark: SparkSession, folder: str, pattern: str = "*.warc*") -> DataFrame:
    """The index of the archives of a folder, gzip by record or plain. A file is read as a stream by one task; a record's header has to lie in its first 64 KB."""
    head = 64 << 10

    def members(stream) -> Iterator[tuple[int, int, bytes]]:
        """(offset, length, first bytes) of each gzip member."""
        at, data = 0, stream.read(1 << 20)
        while data:
            opened, begin, taken = zlib.decompressobj(31), at, b""
            while True:
                part = opened.decompress(data, 1 << 20)
                taken += part[: max(0, head - len(taken))]
                rest = opened.unused_data if opened.eof else opened.unconsumed_tail
                at += len(data) - len(rest)
                data = rest
                if opened.eof:
                    break
                data = data or stream.read(1 << 20)
                if not data and not part:
                    raise EOFError("an archive ends inside a record")
            yield begin, at - begin, taken
            data = data or stream.read(1 << 20)

    def plain(source, size: int) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < size:
            source.seek(at)
            taken = source.read(min(head, size - at))
            fields, start = _fields(taken)
            length = start + int(fields["content-length"]) + 4
            yield at, length, taken
            at += length

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = located(path)
                size, rows = store.get_file_info(place).size, []
                with store.open_input_file(place) as source:
                    zipped = source.read(2) == b"\x1f\x8b"
                    source.seek(0)
                    for offset, length, taken in members(source) if zipped else plain(source, size):
                        fields, _ = _fields(taken)
                        rows.append((path, offset, length, fields.get("warc-type", ""), fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), _digest(fields)))
                        if len(rows) == 1000:
                            yield _batch(rows, *_INDEX)
                            rows = []
                yield _batch(rows, *_INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path").mapInArrow(scan, INDEX)


def read_records(index: DataFrame, payloads: bool = True, rules: WarcRules = WarcRules()) -> DataFrame:
    """The response and revisit records that an index lists, in the columns of ``RECORD``.

    ``payload`` is null for revisits, and for all with ``payloads=False``, where payloads are checked but not
    handed on. Sizes and digests are those of the whole payload, of revisits as their headers have them.
    A payload that differs from its digest is an error, so is a record that its range doesn't hold.
    """

    def parsed(raw: bytes, archive: str, offset: int) -> tuple:
        data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
        fields, start = _fields(data)
        block = data[start : start + int(fields["content-length"])]
        http, body = _fields(block)
        kind, digest, payload = fields["warc-type"], _digest(fields), block[body:]
        size = len(payload)
        if kind == "revisit":
            size, payload = int(http.get("content-length", 0)), None
        elif digest and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload at {offset} of {archive} differs from its digest")
        else:
            digest = hashlib.sha256(payload).hexdigest()
        return archive, offset, kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("warc-target-uri", ""), size, digest, payload if payloads else None

    def spans(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int, int]]]:
        held: list[tuple[str, int, int]] = []
        for one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (one[0] != held[-1][0] or one[1] - held[-1][1] - held[-1][2] > rules.gap or one[1] + one[2] - held[0][1] > rules.span):
                yield held
                held = []
            held.append(one)
        if held:
            yield held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, ""
        for batch in batches:
            for span in spans(batch):
                archive, first, _ = span[0]
                if archive != opened:
                    if source is not None:
                        source.close()
                    store, place = located(archive)
                    source, opened = store.open_input_file(place), archive
                source.seek(first)
                data, rows, held = source.read(span[-1][1] + span[-1][2] - first), [], 0
                for _, offset, length in span:
                    rows.append(parsed(data[offset - first : offset - first + length], archive, offset))
                    held += len(rows[-1][-1] or b"")
                    if held > 8 << 20:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                yield _batch(rows, names, types)

    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    chosen = index.where(F.col("kind").isin("response", "revisit"))
    size = chosen.agg(F.sum("length")).first()[0] or 0
    tasks = max(size // rules.task_bytes + 1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chosen.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of the record that a revisit refers to in place of its own."""
    whole = records.where("kind = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload").alias("_payload"))
    return records.join(whole, "refers_to", "left").withColumn("payload", F.coalesce("payload", "_payload")).select(*[c.split()[0] for c in RECORD.split(", ")])


def page_of(record_id: str) -> Column:
    """The page_id in the name of a record that ``write_archives`` wrote."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:page:(-?[0-9]+)>$', 1) AS long)")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
k AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS kept FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id OR page_id IS NULL THEN kept END AS refers_to FROM k
"""
