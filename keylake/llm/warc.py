"""WARC archives of pages, compressed record by record with an embedded Zstandard dictionary.

Each task writes archives of at most `archive_bytes` of payload: a Zstandard dictionary is built from
the archive's own first records (at most `sample_bytes` of them), stored in a leading skippable
frame, and each record is a frame of its own, so that a record can be read by seeking to its frame.
Equal payloads of `min_bytes` or more are stored once: that with the largest page_id is a response,
the others are revisit records that name it. Files are written under a task attempt's own name and
then renamed; only archives listed in the manifest, a table written once, are read.

Defined cases: a null html is an empty payload; a null page_id is the smallest id (if all ids of a
payload are null, each is a response); rows that repeat the largest page_id of a payload are all
responses; control characters in urls are percent-encoded; an empty table gives no archive; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import batch_of, shared_dir, stored

MIN_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
LEVEL = 3
#: Magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "archive string, records long, payload_bytes long, stored_bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit of refers_to with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or b"" where the records are too few or too small to train one."""
    import zstandard

    sample, total = [], 0
    for r in records:
        sample.append(r[: 64 << 10])
        total += len(sample[-1])
        if total >= SAMPLE_BYTES:
            break
    if len(sample) < 8 or total < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(out, records: list[bytes]) -> None:
    """Records as frames behind the dictionary's skippable frame."""
    import zstandard

    raw = build_dictionary(records)
    if raw:
        packed = zstandard.ZstdCompressor(level=19).compress(raw)
        out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    for r in records:
        out.write(c.compress(r))


def read_archive(source):
    """Yields the records of an open archive, one at a time."""
    import zstandard

    raw, start = None, source.read(8)
    if len(start) == 8 and struct.unpack("<II", start)[0] == DICT_MAGIC:
        raw, start = zstandard.ZstdDecompressor().decompress(source.read(struct.unpack("<II", start)[1])), b""
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = start
    while True:
        if not left:
            left = source.read(1 << 20)
            if not left:
                return
        frame, parts = d.decompressobj(), []
        while not frame.eof:
            if not left:
                left = source.read(1 << 20)
                if not left:
                    raise EOFError("the archive ends inside a record")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with refers_to. Only ids and hashes are grouped; a hot payload is one partial row a task, and its join is left to Spark's skew handling."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    payload = F.encode(html, "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(payload, 256).alias("same"), F.octet_length(html).alias("size"))
    ids = rows.filter(F.col("size") >= min_bytes).select("page_id", "same")
    newest = ids.groupBy("same").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1")
    refs = ids.join(newest, "same").filter("page_id is null or page_id < newest").groupBy("page_id", "same").agg(F.max("newest").alias("refers_to"))
    r, p = refs.alias("r"), rows.alias("p")
    return p.join(r, F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.same") == F.col("r.same")), "left").select("p.page_id", "p.url", "p.html", "r.refers_to")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under folder; returns their manifest, stored beside them."""

    def write(it):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)

        def close(records, size):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with where.open_output_stream(f"{base}/.{name}.part", compression=None) as out:
                write_archive(out, records)
            where.move(f"{base}/.{name}.part", f"{base}/{name}")
            return batch_of({"archive": ([name], pa.string()), "records": ([len(records)], pa.int64()), "payload_bytes": ([size], pa.int64()), "stored_bytes": ([where.get_file_info(f"{base}/{name}").size], pa.int64())})

        records, size = [], 0
        for b in it:
            for page_id, url, html, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                records.append(warc_record(page_id, url, html.encode(), ref))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield close(records, size)
                    records, size = [], 0
        if records:
            yield close(records, size)

    return stored(revisits(pages, min_bytes).mapInArrow(write, MANIFEST), f"{folder}/manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives in the manifest, each archive streamed by one task."""

    def read(it):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])
        for b in it:
            for name in b.column("archive").to_pylist():
                rows = []
                with where.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for data in read_archive(source):
                        rows.append(parse_record(data) | {"archive": name})
                        del rows[-1]["payload"]
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema)

    parts = max(1, manifest.count())
    return manifest.select("archive").repartition(parts, "archive").mapInArrow(read, RECORD)


def op3(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = f"{shared_dir(spark)}-warc"
    manifest = write_warc(pages, folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN newest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest > page_id THEN newest END AS refers_to
FROM p LEFT JOIN m USING (html)
"""
