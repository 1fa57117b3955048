"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

An ARC record is a header line, whose fields depend on the version that the file's first record declares, and as
many bytes as the line's length says. The converter makes of each a WARC record: identifier (a name-based UUID of
archive and offset, so a rerun over the same archives gives the same), WARC-Date from the 14-digit date, type
(an archive's version block: warcinfo; a dns: record without HTTP headers: resource; else response) and SHA-1 digests. Of records with equal payloads of at least
`least` bytes, that with the largest page id stays a response and the others become revisits without payload.

Python parses and frames records; Spark groups the digests (copies combined before the shuffle), joins the decisions
and writes the archives by its text sink: a value is a whole archive of about ARCHIVE_BYTES, the separator that ends
an archive's last record is the sink's line separator, and whole tasks are committed or discarded. Archives are read
by the binaryFile source, one at a time. Only light columns, and the payloads once, are shuffled.

Edge cases: null and empty payloads are records of length 0; null page ids and rows with a small payload are always
responses; rows equal in page id and payload count as copies, of which one is the response; null or empty URLs
become urn:page:<id>, white space and controls in URLs are percent-encoded; a record cut off by its archive's end is
kept with what there is and marked WARC-Truncated; an empty table gives empty archives and an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwatch.llm.common import fresh_path, materialize, table

ARCHIVE_BYTES, LEAST = 8_000_000, 1000
#: Tasks over which the records of one digest are dealt.
SALTS = 16
#: Archives are squeezed less than gzip would by itself, which takes most of the time.
GZIP = {"compression": "gzip", "zlib.compress.level": "THREE"}
#: Fields of a header line by version, as the archives name them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20260101000000"
RECORDS = "archive string, offset long, url string, date string, content_type string, page_id long, head binary, payload binary, payload_bytes long, payload_digest string, truncated boolean"


def arc_url(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def arc_line(version: int, url: str, date: str, mime: str, length: int, offset: int = 0, name: str = "-") -> bytes:
    middle = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime}{middle} {length}\n".encode()


def arc_start(version: int, name: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 lotwatch\n{FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}", DATE, "text/plain", len(body), 0, name) + body


def arc_record(version: int, offset: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
    payload = (html or "").encode()
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    head = "\r\n".join(lines + [f"X-Page-Id: {page_id}"] * (page_id is not None) + ["", ""]).encode()
    return b"\n" + arc_line(version, arc_url(url, page_id), DATE, "text/html", len(head) + len(payload), offset) + head + payload


def write_arcs(pages: DataFrame, path: str, size: int = ARCHIVE_BYTES) -> None:
    """The pages as ARC archives, versions 1 and 2 in turn within each task."""

    def run(batches):
        import pyarrow as pa

        def out(version, parts):
            return pa.RecordBatch.from_pydict({"file": pa.array([b"".join(parts)], pa.binary())})

        no, parts, total = 0, [], 0
        for batch in batches:
            for page_id, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"]):
                version = 1 + no % 2
                if not parts:
                    parts.append(arc_start(version, f"{no:05d}.arc"))
                    total = len(parts[0])
                parts.append(arc_record(version, total + 1, page_id, url, html.as_py()))
                total += len(parts[-1])
                if total >= size:
                    yield out(version, parts)
                    no, parts = no + 1, []
        if parts:
            yield out(1 + no % 2, parts)

    files = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).options(**GZIP).text(path)


def inflate(data: bytes) -> bytes:
    """The content of a file of gzip members, or of one that isn't compressed."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bool]]:
    """(offset, header fields by name, block, cut off?) of each record, the version block first."""
    at, fields = 0, FIELDS[1].split(" ")
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if at == 0 and line.startswith("filedesc:") and " text/plain " in line:
            # The version block opens an archive; its own line has the fields that its second body line names.
            start = data[end + 1 : end + 400].split(b"\n", 2)
            version = int(start[0].split()[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = FIELDS[version].split(" ")
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {line[:200]!r}")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        yield at, dict(zip(fields, values)), block, len(block) < length
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers (with the blank line) and entity; a block without them is all entity."""
    if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[: end + 4], block[end + 4 :]
    return b"", block


def page_id_of(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def read_arcs(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The archives' records but for version blocks, in columns RECORDS; without payloads for counting."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("page_id", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("truncated", pa.bool_())])
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, size = [], 0
                for offset, h, block, cut in parse_arc(inflate(content.as_py())):
                    if offset == 0 and h["URL"].startswith("filedesc:") and h["Content-type"] == "text/plain":
                        continue
                    head, payload = split_http(block)
                    rows.append((name, offset, h["URL"], h["Archive-date"], h["Content-type"], page_id_of(head), head, payload if with_payload else None, len(payload), hashlib.sha1(payload).hexdigest(), cut))
                    size += len(payload)
                    if size > 2_000_000 and with_payload:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter("length > 0").select("path", "content").mapInArrow(run, RECORDS)


def iso_date(date: str) -> str:
    """The WARC date of an ARC date; shorter ones are filled up, others become the epoch."""
    d = (date + "19700101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def base32_digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}:{offset}')}>"


def warc_record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def convert(records: DataFrame, light: DataFrame, path: str, least: int = LEAST, size: int = ARCHIVE_BYTES) -> None:
    """Write ARC records (and their copies without payload, for the grouping) as WARC archives below `path`."""
    light = materialize(light.select("archive", "offset", "url", "date", "page_id", "payload_bytes", "payload_digest"), "arc-records").filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    keepers = (
        light.groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "archive", "offset", "url", "date")).alias("keep"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    # Only rows without payload meet by digest, a common one over SALTS tasks; a payload then finds its own decision.
    copies = light.withColumn("salt", F.pmod(F.xxhash64("archive", "offset"), F.lit(SALTS)).cast("int")).join(keepers, ["payload_digest", "salt"])
    decided = records.join(copies.select("archive", "offset", "keep"), ["archive", "offset"], "left")

    def run(batches):
        import pyarrow as pa

        out = lambda parts: pa.RecordBatch.from_pydict({"file": pa.array([b"\r\n\r\n".join(parts)], pa.binary())})
        info = warc_record("warcinfo", [("WARC-Date", iso_date(DATE)), ("Content-Type", "application/warc-fields")], b"software: lotwatch\r\nformat: WARC File Format 1.0\r\n")
        parts, total = [info], 0
        for batch in batches:
            for r in batch.to_pylist():
                keep = r["keep"]
                revisit = keep is not None and r["page_id"] is not None and (r["archive"], r["offset"]) != (keep["archive"], keep["offset"])
                block = r["head"] if revisit else r["head"] + r["payload"]
                dns = r["url"].startswith("dns:") and not r["head"]
                web = r["content_type"] if dns else "application/http; msgtype=response"
                headers = [
                    ("WARC-Record-ID", record_id(r["archive"], r["offset"])), ("WARC-Date", iso_date(r["date"])), ("WARC-Target-URI", r["url"]), ("Content-Type", web),
                    ("WARC-Payload-Digest", base32_digest(r["payload_digest"])), ("WARC-Block-Digest", base32_digest(hashlib.sha1(block).hexdigest())), ("X-Payload-Length", r["payload_bytes"]),
                    ("WARC-Truncated", "length" if r["truncated"] else None),
                ]
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(keep["archive"], keep["offset"])), ("WARC-Refers-To-Target-URI", keep["url"]), ("WARC-Refers-To-Date", iso_date(keep["date"])), ("X-Refers-To-Page-Id", keep["page_id"])]
                kind = "revisit" if revisit else "resource" if dns else "response"
                parts.append(warc_record(kind, headers, block))
                total += len(parts[-1])
                if total >= size:
                    yield out(parts)
                    parts, total = [info], 0
        if len(parts) > 1:
            yield out(parts)

    files = decided.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).options(**GZIP).option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        length = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """Pages from WARC archives; a response's payload is held against its digest."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string())])
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for h, block in parse_warc(inflate(content.as_py())):
                    kind = h["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind != "revisit" and digest != hashlib.sha1(payload).hexdigest():
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload doesn't match its digest")
                    n = int(h["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    rows.append((page_id_of(head), n, digest, kind, int(h["X-Refers-To-Page-Id"]) if kind == "revisit" else None, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter("length > 0").select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arcs(table(spark, sf_dir, "pages"), arcs)
    convert(read_arcs(spark, arcs), read_arcs(spark, arcs, with_payload=False), warcs)
    return read_warcs(spark, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH t AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS keep FROM t)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM k
"""
