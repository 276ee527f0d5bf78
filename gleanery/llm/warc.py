"""WARC derivative builder: response records in, linked metadata and conversion records out.

For each response record there is
- a `metadata` record (application/warc-fields): the source's status, its HTTP header lines in order, its length and digests,
  the charset used and the page's title;
- a `conversion` record (text/plain; charset=utf-8): the text of an HTML or plain-text payload, one block a line. Payloads of
  other types get the metadata record only.

Both carry WARC-Refers-To (the response's record id), WARC-Refers-To-Target-URI, WARC-Refers-To-Date, the response's
WARC-Payload-Digest as source_payload_digest, and a WARC-Block-Digest of their own; the conversion is WARC-Concurrent-To the
metadata record. Record ids are derived from type, source id and block digest, so a task that runs again makes the same records.
If the source carries a payload digest it is preserved as it stands, else it is computed.

Records are rows, so the number, not the size of WARC files, sets the parallelism. read_warc() and write_warc() go from and to
files of gzip members, one a record.

Cases: a null block makes a metadata record with length 0 and no conversion; an empty payload an empty conversion; broken HTTP
heads are preserved as they stand, characters that can't be decoded become U+FFFD, and a payload in a content coding that isn't
known has no conversion. Repeated response records make repeated
derivatives with equal ids. Blocks of any size are taken whole. An empty table gives none. Columns other than those named are
not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches
from gleanery.llm.html_text import all_text

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gleanery:warc-derivatives")
HTML = ("text/html", "application/xhtml+xml")
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
META_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?([\w:.-]+)", re.I)

#: Columns of a derived record.
DERIVED = [
    ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
    ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("source_block_digest", pa.string()),
    ("source_status", pa.int32()), ("source_content_type", pa.string()), ("source_headers", pa.string()), ("block", pa.binary()),
]
_SQL = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body  # not chunked after all
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, header lines in order, payload as transferred) of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    m = re.match(r"HTTP/\S+\s+(\d{3})", lines[0])
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return int(m[1]) if m else None, fields, body


def payload_text(fields: list[tuple[str, str]], body: bytes) -> tuple[str | None, str, str]:
    """(text of the payload or None, its charset, its title)."""
    get = {k.lower(): v for k, v in fields}
    if get.get("transfer-encoding", "").lower() == "chunked":
        body = _dechunk(body)
    try:
        if (coding := get.get("content-encoding", "").lower()) in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
        elif coding not in ("", "identity"):
            return None, "", ""  # br and others: not to be taken for text
    except (OSError, EOFError, zlib.error):
        return None, "", ""
    kind, _, rest = get.get("content-type", "text/html").partition(";")
    kind = kind.strip().lower()
    if kind not in HTML and not kind.startswith("text/"):
        return None, "", ""
    m = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", rest)
    charset = m[1] if m else ((m := META_CHARSET.search(body[:4096])) and m[1].decode("latin-1")) or "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        charset = "utf-8"
        page = body.decode("utf-8", "replace")
    if kind not in HTML:
        return page, charset.lower(), ""
    title = TITLE.search(page)
    return all_text(page), charset.lower(), " ".join(title[1].split()) if title else ""


def derivatives_of(record_id: str, target_uri: str | None, date: str | None, block: bytes | None, payload_digest: str | None) -> list[tuple]:
    """The derived records of one response, as rows of DERIVED."""
    block = bytes(block) if block is not None else None
    status, fields, body = http(block or b"")
    source_payload, source_block = payload_digest or digest(body), digest(block or b"")
    text, charset, title = payload_text(fields, body) if block is not None else (None, "", "")
    headers = "\r\n".join(f"{k}: {v}" for k, v in fields)
    about = [("source-record-id", record_id), ("source-status", "" if status is None else str(status)), ("source-content-length", str(len(body))), ("source-payload-digest", source_payload), ("source-block-digest", source_block)]
    about += [("charset", charset)] * bool(charset) + [("title", title)] * bool(title) + [("source-header", f"{k}: {v}") for k, v in fields]
    out = []

    def add(kind: str, content_type: str, data: bytes, beside: str | None) -> str:
        own = digest(data)
        name = urn(kind, record_id, own)
        out.append((kind, name, record_id, beside, target_uri, date, content_type, len(data), own, source_payload, source_block, status, dict((k.lower(), v) for k, v in fields).get("content-type"), headers, data))
        return name

    meta = add("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about).encode(), None)
    if text is not None:
        add("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"), meta)
    return out


def derive(responses: DataFrame, keep: tuple[str, ...] = (), with_block: bool = True) -> DataFrame:
    """The derived records of response records (record_id, target_uri, warc_date, payload_digest strings, block binary), with the columns keep of their source."""
    small_batches(responses.sparkSession)
    wanted = [c for c in DERIVED if with_block or c[0] != "block"]
    schema = ", ".join([f"`{c}` {responses.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {_SQL[t]}" for n, t in wanted])
    read = ["record_id", "target_uri", "warc_date", "block", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # a few at a time: both their pages and their texts are in memory
                part = batch.slice(a, 512)
                rows, source = [], []
                for i, args in enumerate(zip(*(part.column(len(keep) + k).to_pylist() for k in range(len(read))))):
                    own = derivatives_of(*args)
                    rows += own
                    source += [i] * len(own)
                own = [pa.array(x, t) for x, (_, t) in zip(zip(*rows), DERIVED)] if rows else [pa.array([], t) for _, t in DERIVED]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(source, pa.int64())) for k in range(len(keep))), *own[: len(wanted)]], names=[*keep, *(n for n, _ in wanted)])

    return responses.select(*[F.col(f"`{c}`") for c in keep], *read).mapInArrow(run, schema)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table page_id, url, html: the pages as an HTTP server would have sent them. Null html is an empty payload."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    h = F.sha1(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))))
    name = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    return pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.lit(None).cast("string").alias("payload_digest"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


# ---- files ----


def record_bytes(row: dict) -> bytes:
    """A WARC/1.1 record of a row: fields that are null are left out."""
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type")]
    fields = [(n, row.get(c)) for n, c in names]
    if row.get("refers_to"):
        fields += [("WARC-Refers-To-Target-URI", row.get("target_uri")), ("WARC-Refers-To-Date", row.get("warc_date")), ("X-Source-Payload-Digest", row.get("source_payload_digest"))]
    block = bytes(row.get("block") or b"")
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields if v) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of a WARC stream (gzip members are read through gzip.GzipFile), one in memory at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields | {"block": stream.read(int(fields.get("content-length", "0")))}


def write_warc(records: DataFrame, folder: str) -> None:
    """One file of gzip members a partition, under a URI that all nodes reach. A task that runs again writes the same file anew and renames it into place."""
    from pyspark import TaskContext

    def save(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():05d}.warc.gz"
        temp = f"{name}.{context.taskAttemptId()}.tmp"
        with store.open_output_stream(temp) as out:
            for r in rows:
                out.write(gzip.compress(record_bytes(r.asDict()), mtime=0))
        store.move(temp, name)

    records.foreachPartition(save)


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] = ("response",), through_spark: bool = False) -> DataFrame:
    """Records of the WARC files at path, as rows that derive() takes.

    A file is a task's work; files are of about a GB by custom. Tasks stream them from the store, record by record, so that they
    hold one batch of records. through_spark: for stores that only Spark reads; a whole file is then in memory as one row.
    """
    cols = ["record_id", "target_uri", "warc_date", "payload_digest", "warc_type", "refers_to", "content_type", "block"]
    names = ["warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-type", "warc-refers-to", "content-type", "block"]
    kinds = [pa.string()] * 7 + [pa.binary()]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows], t) for n, t in zip(names, kinds)], names=cols)

    def opened(value: pa.Scalar) -> io.BufferedIOBase:
        if through_spark:
            return io.BytesIO(value.as_buffer())
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(value.as_py())
        return io.BufferedReader(store.open_input_file(name), 1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                raw = opened(value)
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows: list[dict] = []
                size = 0
                for r in parse_records(gzip.GzipFile(fileobj=raw) if zipped else raw):
                    if r.get("warc-type") in types:
                        rows.append(r)
                        size += len(r["block"])
                    if size > 16 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                yield packed(rows)

    files = spark.read.format("binaryFile").load(path)
    files = files.select("content") if through_spark else files.select(F.regexp_replace("path", "^file:/+", "file:///"))
    return files.mapInArrow(run, "record_id string, target_uri string, warc_date string, payload_digest string, warc_type string, refers_to string, content_type string, block binary")
