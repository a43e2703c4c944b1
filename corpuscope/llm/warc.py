"""Web archives: writing captures as WARC records, reading records, assembling transactions.

A capture is three records: the response (or a revisit of an earlier response with the same payload),
its request and its metadata. The latter two name the first by ``WARC-Concurrent-To``; assembly joins
them again through these names, in whatever direction and order an archive has them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import materialize

END = "\r\n"
#: Records in one archive at most; bounds what a reading task holds.
RECORDS_PER_FILE = 3000
#: Tasks that the pages of one payload may be dealt to.
SALTS = 256
_DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource", "conversion")


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8, without padding: 160 bits are 32 digits."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cut = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    # Headers without a value are null and left out.
    return F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block)


def with_first(page: DataFrame) -> DataFrame:
    """``page`` with ``first_id``, the smallest ``page_id`` with its ``digest``. The pages of one digest
    are dealt to ``SALTS`` tasks, and the smallest id is sent to those of them that have any."""
    page = page.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    first = page.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.collect_set("_salt").alias("_salts"))
    first = first.select("digest", "first_id", F.explode("_salts").alias("_salt"))
    return page.join(first, ["digest", "_salt"]).drop("_salt")


def capture_records(pages: DataFrame) -> DataFrame:
    """One ``value`` per record of ``pages`` (``page_id``, ``url``, ``html``), three per page.

    Of pages with equal payloads the one with the smallest id is a response and the others revisit it;
    a null id comes last. Only the response has the payload."""
    page = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        # Line ends would end the header.
        F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    page = with_first(page.withColumn("digest", sha1_base32(F.col("html"))))
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    name = lambda k, i: _uuid(F.lit(k) if isinstance(k, str) else k, i, F.col("digest"))
    own = name(F.lit("capture"), F.col("page_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length("html").cast("string"),
        F.lit(END * 2),
    )
    common = [("WARC-Date", F.lit(_DATE)), ("WARC-Target-URI", F.col("url"))]
    main = _record(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", own),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisits, F.lit(_REVISIT))),
            ("WARC-Refers-To", F.when(revisits, name(F.lit("capture"), F.col("first_id")))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisits, http).otherwise(F.concat(http, "html")),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", name(F.lit("request"), F.col("page_id"))),
            *common,
            ("WARC-Concurrent-To", own),
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END * 2}")),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", name(F.lit("metadata"), F.col("page_id"))),
            *common,
            ("WARC-Concurrent-To", own),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")),
    )
    return page.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the records of ``pages`` as compressed archives under ``path``. The two line ends that
    close a record are the separator of Spark's text writer, which adds nothing else. Archives are
    compressed by the fastest level: the usual one takes most of the time of writing."""
    writer = capture_records(pages).write.option("maxRecordsPerFile", records_per_file)
    writer.option("lineSep", END * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _unpacked(content: bytes) -> Iterator[bytes]:
    """Parts of an archive, which may be plain or any number of compressed members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        stream = zlib.decompressobj(31)
        while content and not stream.eof:
            yield stream.decompress(content, 1 << 20)
            content = stream.unconsumed_tail or stream.unused_data
            if not stream.eof and not stream.unconsumed_tail:
                raise ValueError("a compressed archive ends in the middle of a member")
        content = content.lstrip(b"\0")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (by lower-case name) and block of each record. Only Content-Length says where a block
    ends, so it may hold anything. A cut or malformed archive is an error."""
    parts, held, at = _unpacked(content), b"", 0

    def fill(n: int) -> bool:
        """Makes ``n`` bytes from ``at`` on available, if there are as many."""
        nonlocal held, at
        if len(held) - at < n:
            more, size = [held[at:]], len(held) - at
            while size < n and (part := next(parts, None)) is not None:
                more.append(part)
                size += len(part)
            held, at = b"".join(more), 0
        return len(held) - at >= n

    while True:
        while fill(2) and held.startswith(b"\r\n", at):
            at += 2
        if not fill(1):
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(held) - at + 1):
                raise ValueError("a record has no end of headers")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        headers: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        begin, length = end + 4 - at, int(headers["content-length"][0])
        if not fill(begin + length):
            raise ValueError("a record is shorter than its Content-Length")
        yield headers, held[at + begin : at + begin + length]
        at += begin + length


_RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("fields", pa.string()),
        ("payload", pa.binary()),
    ]
)
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes bigint, fields string, payload binary"
)


def _row(headers: dict[str, list[str]], block: bytes, with_payload: bool) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    kind, payload, fields, size = one("warc-type"), None, None, None
    digest = (one("warc-payload-digest") or "").rpartition(":")[2] or None
    if kind in ANCHORS:
        head, split, body = block.partition(b"\r\n\r\n")
        if not (one("content-type") or "").startswith("application/http"):
            head, body = b"", block
        if kind == "revisit":
            sizes = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(sizes[0]) if sizes else None
        else:
            payload, size = body, len(body)
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    else:
        fields = block.decode("utf-8", "replace")
    ids = headers.get("warc-concurrent-to", [])
    return one("warc-record-id"), kind, ids, one("warc-refers-to"), one("warc-target-uri"), digest, size, fields, payload if with_payload else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records under ``path``. Of a response the payload's size and digest are those of the bytes
    that are there; of a revisit, those its headers name. An archive is read by one task, which holds
    it in compressed form; Spark reads files of up to 2 GB in this way."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for headers, block in parse_records(content.as_py()):
                    rows.append(_row(headers, block, with_payload))
                    held += len(block)
                    if held > 1 << 23 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id``, ``response`` (the record), ``request`` (the first by id) and
    ``metadata`` (all, by id).

    A request or metadata record belongs to a capture if either names the other as concurrent, or
    through a request that does. Records that reach no response are captures with a null
    ``response``, under the id they name, or their own. Copies of a record with one id are one."""
    anchors = records.where(F.col("record_type").isin(*ANCHORS)).withColumnRenamed("record_id", "capture_id")
    others = records.where(~F.col("record_type").isin(*ANCHORS)).drop("payload")
    named = others.select("record_id", F.explode_outer("concurrent_to").alias("to"))
    ids = anchors.select("capture_id").distinct()
    down = anchors.select("capture_id", F.explode("concurrent_to").alias("record_id"))
    down = down.groupBy("record_id").agg(F.min("capture_id").alias("by_anchor"))
    step = named.join(ids.withColumnRenamed("capture_id", "to").withColumn("found", F.col("to")), "to", "left")
    step = step.join(down, "record_id", "left")
    step = step.groupBy("record_id").agg(
        F.coalesce(F.min("found"), F.min("by_anchor")).alias("capture_id"), F.min("to").alias("to")
    )
    through = step.where("capture_id IS NOT NULL").select(F.col("record_id").alias("to"), F.col("capture_id").alias("through"))
    link = step.join(through, "to", "left").select(
        "record_id", F.coalesce("capture_id", "through", "to", "record_id").alias("capture_id")
    )
    columns = ["record_id", "target_uri", "fields"]
    part = others.join(link, "record_id")
    request = part.where("record_type = 'request'").groupBy("capture_id").agg(F.min(F.struct(*columns)).alias("request"))
    rest = part.where("record_type <> 'request' OR record_type IS NULL").groupBy("capture_id")
    rest = rest.agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("metadata"))
    response = anchors.select("capture_id", F.struct(*[c for c in anchors.columns]).alias("response"))
    response = response.dropDuplicates(["capture_id"])
    return response.join(request, "capture_id", "full_outer").join(rest, "capture_id", "full_outer")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` under ``path``, reads them back and describes each capture: ``page_id``,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (the page of the response
    that a revisit stands for).

    A null ``html`` is an empty payload; a null ``url`` leaves the header out; rows that repeat a page
    with its payload are one capture; a page with two payloads is two; an empty table gives no
    rows. Other columns of ``pages`` are ignored."""
    write_archives(pages, path)
    # Assembly joins the records with themselves, so they are parsed once and kept without payloads.
    captures = assemble(materialize(read_archives(pages.sparkSession, path, with_payload=False), "records"))
    page = F.regexp_extract(F.array_join(F.transform("metadata", lambda m: m["fields"]), "\n"), r"(?m)^page-id: (-?[0-9]+)", 1)
    out = captures.select("response.*", F.nullif(page, F.lit("")).cast("bigint").alias("page_id"))
    origin = out.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("origin"))
    out = out.join(origin, "refers_to", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("origin").alias("refers_to"))
