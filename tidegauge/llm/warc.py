"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records, each a gzip member of its own: the response, or
a revisit where an equal payload is stored already, and a request and a metadata record
that name it in ``WARC-Concurrent-To``. Archives are written and read by Spark's own
sources, so any store that Spark reaches will do: the text sink writes the members as
they are, with an empty gzip member as its line separator, and ``binaryFile`` reads them.
A file is parsed by one task; ``write_archives`` makes a file of each partition.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, settle

#: A gzip member that holds nothing.
NOTHING = gzip.compress(b"", mtime=0)
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, declared_digest string, content_type string, http_status int, http_length bigint, payload binary, payload_digest string"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("declared_digest", pa.string()), ("content_type", pa.string()), ("http_status", pa.int32()), ("http_length", pa.int64()), ("payload", pa.binary()), ("payload_digest", pa.string())])
#: Bytes of payloads that a batch returned by the reader may hold before it is closed.
BATCH_BYTES = 8 << 20
#: Captures of a file at most, so that a file fits the memory of the task that reads it.
FILE_RECORDS = 20_000
#: Compressed bytes given to zlib at once.
STEP = 4096


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return zlib.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 1, wbits=31)


def _one_line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def _capture(page_id: int | None, url: str | None, payload: bytes, first: int | None, name: str | None) -> bytes:
    """The three records of a capture; ``first`` is the page that holds the payload, None for a response. The response that others refer to has no ``name``."""
    sha, url = digest(payload), _one_line(url)
    main = f"<urn:capture:{page_id}:{sha}>" if name is None else f"<urn:capture:{page_id}:{sha}:{name}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if first is None else "revisit"
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        fields += [("WARC-Refers-To", f"<urn:capture:{first}:{sha}>"), ("WARC-Profile", REVISIT_PROFILE)]
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)([^#]*)", url or "")
    asked = f"GET {(m and m[2]) or '/'} HTTP/1.1\r\nHost: {(m and m[1]) or '-'}\r\n\r\n".encode()
    about = ("" if page_id is None else f"page-id: {page_id}\r\n").encode() + b"payload-bytes: %d\r\n" % len(payload)
    beside = [("WARC-Target-URI", url), ("WARC-Concurrent-To", main)]
    return b"".join(
        [
            _record(kind, main, fields, http + (payload if first is None else b"")),
            _record("request", main[:-1] + ":request>", [*beside, ("Content-Type", "application/http;msgtype=request")], asked),
            _record("metadata", main[:-1] + ":metadata>", [*beside, ("Content-Type", "application/warc-fields")], about),
        ]
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        out, held = [], 0
        for page_id, url, payload, first, leads in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "leads")), strict=True):
            out.append(_capture(page_id, url, payload, first, None if leads else f"{part}-{n}"))
            held += len(out[-1])
            n += 1
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write a capture of each row of ``pages`` below ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest id is a response and the others revisit it; smaller payloads are always
    responses. Payloads are the html in UTF-8, empty for null. Rows that share the
    smallest id, and payloads that have no id at all, are responses all of them. Line
    breaks in URLs are written percent-encoded.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("bytes", F.length("payload")).withColumn("full", F.sha2("payload", 256))
    key = ["bytes", "full"]
    each = keyed.where(F.col("bytes") >= least_bytes).groupBy(*key, "page_id").agg(F.count("*").alias("n"))
    lead = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    groups = each.groupBy(*key).agg(lead.alias("lead"), F.sum("n").alias("rows")).where("rows > 1")
    groups = settle(groups.select(*key, F.col("lead.page_id").alias("first"), F.coalesce(F.col("lead.n") > 1, F.lit(False)).alias("tied")), "warc-groups")
    own, numbered = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), None
    if groups.where("tied").isEmpty():
        known, leads = keyed.join(groups, key, "left"), own
    else:  # rows that share the smallest id are told apart by a number, which is kept: it may be another when rows are read again
        numbered = settle(keyed.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
        heads = numbered.select(*key, "page_id", "row").join(groups.where("tied"), key).where(own).groupBy(*key).agg(F.min("row").alias("head"))
        known = numbered.join(groups.join(heads, key, "left"), key, "left")
        leads = own & (F.coalesce("head", "row") == F.col("row"))
    # a row that leads its group is named by page and digest alone, which is what the others refer to
    known = known.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"), leads.alias("leads"))
    known.mapInArrow(_members, "member binary").select(F.col("member").cast("string")).write.option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    release(groups, numbered)


def _inflate(data: bytes) -> bytes:
    """All gzip members of ``data``; it is fed in steps, since what a member leaves over is copied."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, view, at = [], memoryview(data), 0
    while at < len(data):
        d = zlib.decompressobj(31)
        while not d.eof and at < len(data):
            step = view[at : at + STEP]
            out.append(d.decompress(step))
            at += len(step) - len(d.unused_data)
        if not d.eof:
            raise ValueError("a gzip member ends too early")
    return b"".join(out)


def _parse(data: bytes, name: str) -> Iterator[tuple]:
    """The records of an archive, gzipped or not; a body ends by its length, whatever it contains."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at} of {name}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        size = int(fields[b"content-length"])
        block, at = data[end + 4 : end + 4 + size], end + 8 + size
        if len(block) < size:
            raise ValueError(f"{name} ends within a record")
        kind, content_type = fields.get(b"warc-type"), fields.get(b"content-type", "")
        status = length = None
        payload = block
        if content_type.startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            if m := re.match(rb"HTTP/\S+ (\d+)", head):
                status = int(m[1])
            if m := re.search(rb"(?i)\r\ncontent-length: *(\d+)", head):
                length = int(m[1])
        declared = fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
        sha = digest(payload) if kind == "response" else None
        if sha and declared and sha != declared:
            raise ValueError(f"{name}: the payload of {fields.get(b'warc-record-id')} has another digest than its header says")
        yield (fields.get(b"warc-record-id"), kind, fields.get(b"warc-concurrent-to"), fields.get(b"warc-refers-to"), fields.get(b"warc-target-uri"), declared, content_type, status, length, payload if kind != "revisit" else None, sha)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, held = [], 0
            for r in _parse(_inflate(batch.column("content")[i].as_py()), batch.column("path")[i].as_py()):
                rows.append(r)
                held += len(r[9] or b"") + 300
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; broken archives raise an error."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_records, RECORD)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response``, ``request``, ``metadata``, ``n_requests`` and ``n_metadata``.

    Responses and revisits are captures. Requests and metadata records join the capture
    that they are concurrent to. Of several, the one with the smallest id is shown and
    all are counted; :func:`unassembled` returns the others, and those whose capture is
    missing. All columns of ``records`` are kept inside the structs.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])

    def beside(kind: str, n: str) -> DataFrame:
        return records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(row, F.col("record_id")).alias(kind), F.count("*").alias(n))

    main = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), row.alias("response"))
    joined = main.join(beside("request", "n_requests"), "capture_id", "left").join(beside("metadata", "n_metadata"), "capture_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_requests", "n_metadata")})


def unassembled(records: DataFrame) -> DataFrame:
    """The requests and metadata records that no nested row shows, and records of other types."""
    shown = records.where(F.col("concurrent_to").isNotNull()).groupBy("record_type", "concurrent_to").agg(F.min("record_id").alias("record_id"))
    captures = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("concurrent_to")).distinct()
    shown = shown.where(F.col("record_type").isin("request", "metadata")).join(captures, "concurrent_to", "left_semi")
    return records.where(~F.coalesce(F.col("record_type").isin("response", "revisit"), F.lit(False))).join(shown, ["record_type", "concurrent_to", "record_id"], "left_anti")


def page_captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture below ``path``."""
    slim = read_records(spark, path).withColumns({
        "payload_bytes": F.when(F.col("record_type") == "response", F.length("payload").cast("long")).otherwise(F.col("http_length")),
        "sha": F.coalesce("payload_digest", "declared_digest"),
        "page_id": F.when(F.col("record_type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"(?m)^page-id: (-?\d+)\r?$", 1)),
    }).select("record_id", "record_type", "concurrent_to", "refers_to", "payload_bytes", "sha", "page_id")
    slim = settle(slim, "warc-records")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return assemble_transactions(slim).select(
        number("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.sha").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), number(r"regexp_extract(response.refers_to, '^<urn:capture:(-?[0-9]+):', 1)").alias("refers_to"),
    )
