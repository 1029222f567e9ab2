"""Legacy archive converter: ARC records become WARC records, written to and read back from the shared folder.

ARC archives begin with a version block whose first line also declares its own length; version 1 record lines have
five fields, version 2 lines ten, and each ends in the length of the network document behind it.  The converter parses
the lines of the version declared and synthesises what WARC asks for and ARC lacks: a record identifier (a name-based
UUID over URL, date and place), an ISO timestamp, a record type and SHA-256 digests.  Of equal payloads of at least
``MIN_REVISIT`` bytes the first - smallest page_id, then place - is the response, the others are revisits without payload.

WARC files hold one gzip member a record, so a record can be read alone, and are bounded by bytes: records are written by
classes of size, each with as many to a file as FILE_BYTES allow.  A task's first file begins with a warcinfo record.

Null payloads are empty and null URLs become ``urn:unknown``; blanks in a URL are percent-encoded.  A null page_id is
kept null and comes after all others; equal rows are records of their own.  Very long payloads are a file of their own.  An empty table
gives no record.  Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

MIN_REVISIT = 100
ARCHIVE_BYTES = 4 << 20
#: Uncompressed bytes of a WARC file, and the classes of payload size that are written together; a longer record is a file.
FILE_BYTES, SIZE_CLASSES = 64 << 20, (1 << 14, 1 << 18, 1 << 22, 1 << 31)
#: Fields of a record line, by version (fixed by the format).
ARC_FIELDS = {
    b"1": ("url", "ip", "date", "type", "length"),
    b"2": ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
ARC_TITLES = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length\n",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n",
}
CRAWL_DATE = "20240101000000"


# ---------------------------------------------------------------- ARC
def arc_line(version: bytes, url: bytes, kind: bytes, offset: int, name: bytes, length: int) -> bytes:
    own = {"url": url, "ip": b"0.0.0.0", "date": CRAWL_DATE.encode(), "type": kind, "code": b"200", "checksum": b"-", "location": b"-", "offset": b"%d" % offset, "file": name, "length": b"%d" % length}
    return b" ".join(own[f] for f in ARC_FIELDS[version]) + b"\n"


def arc_archive(version: bytes, name: bytes, pages: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """An archive of HTTP responses; the page's id travels as a response header."""
    about = version + b" 0 tessera\n" + ARC_TITLES[version]
    out = [arc_line(version, b"filedesc://" + name, b"text/plain", 0, name, len(about)), about, b"\n"]
    at = sum(map(len, out))
    for page_id, url, payload in pages:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + (b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id) + b"Content-Length: %d\r\n\r\n" % len(payload)
        where = "".join(c if c > " " else "%%%02X" % ord(c) for c in (url or "")).encode() or b"urn:unknown"
        line = arc_line(version, where, b"text/html", at, name, len(head) + len(payload))
        out += [line, head, payload, b"\n"]
        at += len(line) + len(head) + len(payload) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(fields of the record line, network document) of every record behind the version block."""
    end = data.index(b"\n")
    length = int(data[:end].rsplit(b" ", 1)[1])
    fields = ARC_FIELDS[data[end + 1 : end + 1 + length].split(b" ", 1)[0]]
    at = end + 1 + length
    while at < len(data):
        if data[at : at + 1] == b"\n":  # separator
            at += 1
            continue
        end = data.index(b"\n", at)
        own = dict(zip(fields, data[at:end].split(b" "), strict=True))
        n = int(own["length"])
        if end + 1 + n > len(data):
            raise ValueError(f"record at {at} declares {n} bytes beyond the archive's end")
        yield own, data[end + 1 : end + 1 + n]
        at = end + 1 + n


def arc_archives(pages: DataFrame) -> DataFrame:
    """Binary ARC archives of a few MB; versions 1 and 2 take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            ids, urls, texts = (batch.column(i) for i in range(3))
            _, off = C.text_block(texts)
            for i, j in C.sub_blocks(off, ARCHIVE_BYTES):
                rows = [(p, u, (t or "").encode()) for p, u, t in zip(ids[i:j].to_pylist(), urls[i:j].to_pylist(), texts[i:j].to_pylist(), strict=True)]
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([arc_archive(b"12"[k % 2 : k % 2 + 1], b"part-%06d.arc" % k, rows)], pa.binary())], names=["arc"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "arc binary")


# ---------------------------------------------------------------- WARC
def split_http(block: bytes) -> tuple[bytes, bytes]:
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def http_field(head: bytes, name: bytes) -> int | None:
    for line in head.split(b"\r\n")[1:]:
        if line.lower().startswith(name + b":"):
            return int(line.split(b":", 1)[1])
    return None


def iso_date(arc_date: bytes) -> str:
    d = arc_date.decode().ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


CONVERTED = "page_id long, uri string, date string, head binary, payload binary, payload_bytes long, digest string"


def convert(archives: DataFrame) -> DataFrame:
    """Parsed records with what WARC needs but for identifier and type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for own, document in parse_arc(data.as_py()):
                    head, payload = split_http(document)
                    rows.append((http_field(head, b"x-page-id"), own["url"].decode(), iso_date(own["date"]), head, payload, len(payload), hashlib.sha256(payload).hexdigest()))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "uri", "date", "head", "payload", "payload_bytes", "digest"])

    return archives.mapInArrow(run, CONVERTED)


def record_id(uri: str, date: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date}/{place}/{uri}')}>"


def warc_record(uri, date, place, head, payload, digest, first) -> bytes:
    """One record; ``first`` is (uri, date, place) of the response that a revisit refers to."""
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(uri, date, place)), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if first:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*first)), ("WARC-Refers-To-Target-URI", first[0]), ("WARC-Refers-To-Date", first[1])]
    block = head if first else head + payload
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    own = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return own, data[end + 4 : end + 4 + int(own["content-length"])]


def zipped(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, as the length field of all records below 16 MB does; others get an empty member behind."""
    member = gzip.compress(record, 5, mtime=0)
    return member if member[-1] == 0 else member + gzip.compress(b"", 5, mtime=0)


def members(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of all gzip members that are not empty, one at a time."""
    at = 0
    while at < len(data):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof and at < len(data):
            out.append(unpack.decompress(data[at : at + step]))
            at += step
        at -= len(unpack.unused_data) + max(0, at - len(data))
        if not unpack.eof:
            raise ValueError("the last gzip member is cut")
        if any(out):
            yield b"".join(out)


def warcinfo() -> bytes:
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'tessera/warcinfo')}>"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {name}\r\nWARC-Date: {iso_date(CRAWL_DATE.encode())}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def write_warc(archives: DataFrame, path: str) -> None:
    """Converts ARC archives and writes WARC files of gzip members under path, through Spark's own file writer."""
    records = C.materialize(convert(archives).withColumn("place", F.monotonically_increasing_id()), "arc_records")
    order = F.struct(F.col("page_id").isNull().alias("late"), "page_id", "place", "uri", "date")
    long = F.col("payload_bytes") >= MIN_REVISIT
    firsts = C.materialize(records.where(long).groupBy("digest").agg(F.min(order).alias("first")), "first_records")
    decided = records.select("place", "digest", "payload_bytes").where(long).join(firsts, "digest")
    # payloads move once, dealt by record and not by digest; what revisits leave out does not move at all
    decided = decided.where(F.col("first.place") != F.col("place")).select("place", F.struct("first.uri", "first.date", "first.place").alias("first"))
    decided = C.materialize(decided, "revisits")
    joined = records.join(decided, "place", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [warcinfo()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = before
                for r in batch.slice(lo, 256).to_pylist():
                    first = r["first"] and (r["first"]["uri"], r["first"]["date"], r["first"]["place"])
                    out.append(warc_record(r["uri"], r["date"], r["place"], r["head"], r["payload"], r["digest"], first))
                before = []
                yield pa.RecordBatch.from_arrays([pa.array([zipped(x)[:-1] for x in out], pa.binary())], names=["value"])

    # the text writer, told to end its lines with a zero byte, puts the last byte of each record back
    sizes = {r["k"] for r in records.select(F.least(*[F.when(F.col("payload_bytes") < b, k) for k, b in enumerate(SIZE_CLASSES)]).alias("k")).distinct().collect()}  # four numbers
    for k in sorted(sizes) or [0]:  # an empty table gives a file without records
        low, high = SIZE_CLASSES[k - 1] if k else 0, SIZE_CLASSES[k]
        own = joined.where((F.col("payload_bytes") >= low) & (F.col("payload_bytes") < high))
        lines = own.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
        lines.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", max(1, FILE_BYTES // (high + 1024))).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """Every record of the files under path: page_id, uri, record_id, type, digest, payload_bytes, refers_to_record, payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for own, block in map(parse_record, members(memoryview(content.as_buffer()))):
                    if own["warc-type"] == "warcinfo":
                        continue
                    if f"sha256:{hashlib.sha256(block).hexdigest()}" != own["warc-block-digest"]:
                        raise ValueError(f"block of {own['warc-record-id']} differs from its digest")
                    head, payload = split_http(block)
                    revisit = own["warc-type"] == "revisit"
                    digest = own["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    size = http_field(head, b"content-length") if revisit else len(payload)
                    rows.append((http_field(head, b"x-page-id"), own["warc-target-uri"], own["warc-record-id"], own["warc-type"], digest, size, own.get("warc-refers-to"), payload))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = ["page_id", "uri", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to_record", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    schema = "page_id long, uri string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_record string, payload binary"
    return files.mapInArrow(run, schema)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Pages as ARC, converted to WARC files, and read back without payloads; refers_to is found by record identifier."""
    spark = pages.sparkSession
    path = C.scratch(spark, "warc")
    write_warc(arc_archives(pages), path)
    read = C.materialize(read_warc(spark, path).drop("payload"), "warc_records")
    named = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    # only revisits have something to look up; a response that very many refer to is one row of the written table
    revisits = read.where("record_type = 'revisit'").join(named, "refers_to_record")
    responses = read.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "record_id")
    return responses.select(*columns).unionByName(revisits.select(*columns))
