"""WARC archives: transactions are written, and assembled again from their records.

Writing. A capture is three records: the request, the response (or a revisit
where an equal payload is stored elsewhere) and a metadata record with the
fields of the row; request and metadata name the response in WARC-Concurrent-To.
Payloads of `SHARED_BYTES` bytes and more that several rows have are stored
once, with the smallest id; the others are revisits of the profile
identical-payload-digest and name that payload by digest and target URI. One
text row holds one transaction, and the separator of the text writer is the
empty lines that end a record, so Spark's own writers make the archives, on any
store and with its commits, and no Python touches the texts.

Reading. Archives (plain or gzip, of one or many members) come as binary rows,
are cut into records by Content-Length with a streaming decompressor, and every
payload is hashed where it is read. Assembly then joins the records: those of a
transaction find their response through WARC-Concurrent-To, named directly or
through another record of the transaction, and each capture becomes one nested
row. A revisit is resolved by the digest of its payload.

Size. A task holds one archive as bytes; `ROWS_A_FILE` bounds those written here.
Payloads go through one shuffle when written. Assembly moves headers and digests
alone unless `payloads` asks for the bytes. Hot payloads are keys of plain joins
(adaptive execution splits them) and of sums with a map-side part.

Defined cases: a null html is an empty payload, a null url an empty target; rows
with a null id are captures of their own, have no id to refer to and are only
the response of a group in which nobody has an id; rows that repeat an id with
an equal payload are responses all of them if that id is the smallest; requests
and metadata that name no response found are a capture without response; a
record cut short by the end of its archive is left out; a revisit whose payload
is in no archive read keeps the digest it states and has a null size; other
columns are ignored; an empty table makes archives without records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import prepare, saved
from tickloom.session import fresh_dir

SHARED_BYTES = 100
ROWS_A_FILE = 2000
BATCH_PAYLOAD = 4 << 20
PIECE = 1 << 18

CRLF = "\r\n"
RECORD_END = b"\r\n\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_REQUEST = "application/http; msgtype=request"
HTTP_RESPONSE = "application/http; msgtype=response"
FIELDS = "application/warc-fields"


def _one_line(text: Column) -> Column:
    """A header's value: line ends and other control characters would break it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", " ")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(VERSION)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        lines += [F.lit(f"{CRLF}{name}: "), value]
    return F.concat(*lines, F.lit(CRLF + CRLF), block)


def _urn() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def decided(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """id, url, html, digest, size and `first`: the id whose row stores the payload, where several rows have it."""
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.col(key).cast("long").alias("id"), _one_line(F.col(url).cast("string")).alias("url"), body)
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    # Small payloads share nothing: a key of their own keeps them from meeting in one place.
    own = F.concat_ws("-", F.lit("own"), F.col("id"), F.hex(F.xxhash64("url")))
    rows = rows.withColumn("payload", F.when(F.col("size") >= shared_bytes, F.col("digest")).otherwise(own))
    large = rows.where(F.col("size") >= shared_bytes)
    shared = large.groupBy("payload").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(shared, "payload", "left").drop("payload")


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip", shared_bytes: int = SHARED_BYTES
) -> None:
    """Archives of all rows below `path`, a request, a response or revisit and a metadata record each."""
    prepare(pages.sparkSession)
    rows = decided(pages, key, url, html, shared_bytes)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    # The three ids are drawn before they are used twice.
    rows = rows.select("*", revisit.alias("revisit"), *[_urn().alias(f"{x}_id") for x in ("request", "response", "metadata")])
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    after_host = F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    path_of = F.regexp_replace(F.when(after_host.startswith("/"), after_host).otherwise(F.concat(F.lit("/"), after_host)), r"#.*$| ", "")
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    told = F.concat(F.lit("row-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-bytes: "), F.col("size").cast("string"), F.lit(CRLF))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", now)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))

    def heads(kind: str, own: str, content: str, *more: tuple[str, Column]) -> list[tuple[str, Column]]:
        return [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.col(f"{own}_id")), *common, ("Content-Type", F.lit(content)), *more]

    joined = ("WARC-Concurrent-To", F.col("response_id"))
    stored_here = _record(heads("response", "response", HTTP_RESPONSE, digest), F.concat(head, F.col("html")))
    stored_there = _record(heads("revisit", "response", HTTP_RESPONSE, digest, ("WARC-Profile", F.lit(IDENTICAL_PAYLOAD))), head)
    transaction = F.concat_ws(
        CRLF + CRLF,
        _record(heads("request", "request", HTTP_REQUEST, joined), asked),
        F.when(F.col("revisit"), stored_there).otherwise(stored_here),
        _record(heads("metadata", "metadata", FIELDS, joined), told),
    )
    writer = rows.select(transaction.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", ROWS_A_FILE)
    writer.option("compression", compression).text(path)


class _Source:
    """Bytes of an archive, plain or gzip, read piece by piece."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.held = data, 0, bytearray()
        self.zipped = bytes(data[:2]) == b"\x1f\x8b"
        self.opened = zlib.decompressobj(31) if self.zipped else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + PIECE]
        self.at += len(piece)
        if self.opened is None:
            self.held += piece
            return True
        self.held += self.opened.decompress(piece)
        if self.opened.eof:  # the next member begins where this one ended
            self.at -= len(self.opened.unused_data)
            self.opened = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to the mark, which is consumed; None at the end of the archive."""
        seen = 0
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            if not self._more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip_blank(self) -> None:
        """What lies between two records."""
        while True:
            rest = self.held.lstrip(b"\r\n")
            if rest or not self._more():
                self.held = bytearray(rest)
                return


def _fields(lines: list[str]) -> dict[str, str]:
    """Named fields by lower-case name; of repeated ones the last. A line that begins with a blank goes on."""
    out, name = {}, ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parsed(data: memoryview) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """Fields, all concurrent ids and block of every whole record of an archive."""
    source = _Source(data)
    while True:
        source.skip_blank()
        head = source.until(RECORD_END)
        if head is None:
            return
        lines = head.decode("utf-8", "replace").split(CRLF)
        fields = _fields(lines[1:])
        named = [x.partition(":")[2].strip() for x in lines[1:] if x[:19].lower() == "warc-concurrent-to:"]
        size = fields.get("content-length", "")
        block = source.take(int(size)) if size.isdigit() else None
        if block is None or not lines[0].startswith("WARC/"):
            return
        yield fields, named, block


RECORDS = pa.schema(
    [
        ("archive", pa.string()),
        ("record_id", pa.string()),
        ("kind", pa.string()),
        ("concurrent", pa.list_(pa.string())),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("stated_digest", pa.string()),
        ("first_line", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("payload", pa.binary()),
    ]
)
RECORDS_DDL = (
    "archive string, record_id string, kind string, concurrent array<string>, target_uri string, date string, stated_digest string, "
    "first_line string, fields map<string,string>, payload_bytes long, payload_sha256 string, payload binary"
)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: its headers, the fields of a metadata block, the first
    line and fields of an HTTP block, and size and SHA-256 of the payload behind it."""
    prepare(spark)

    def one(archive: str, fields: dict, named: list[str], block: bytes) -> tuple:
        content, first, own, payload = fields.get("content-type", "").lower(), None, {}, block
        if content.startswith("application/http"):
            head, _, payload = block.partition(RECORD_END)
            lines = head.decode("utf-8", "replace").split(CRLF)
            first, own = lines[0], _fields(lines[1:])
        elif content.startswith(FIELDS):
            own = _fields(block.decode("utf-8", "replace").split(CRLF))
        kind = fields.get("warc-type", "").lower()
        return (
            archive, fields.get("warc-record-id"), kind, named, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-payload-digest"),
            first, list(own.items()), len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                archive = batch.column("path")[place].as_py()
                content = batch.column("content")[place].as_buffer()
                held, size = [], 0
                for fields, named, block in parsed(memoryview(content) if content is not None else memoryview(b"")):
                    held.append(one(archive, fields, named, block))
                    size += len(block) if payloads else 400
                    if size > BATCH_PAYLOAD:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS_DDL)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), RECORDS, strict=True)], schema=RECORDS)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (kind, headers and payload of
    the response or revisit, null if there is none), requests and metadata.

    Records that name a response are joined with it; those that name another
    record of the transaction inherit what that one names.
    """
    is_head = F.col("kind").isin("response", "revisit", "resource")
    heads, others = records.where(is_head), records.where(~is_head & (F.col("kind") != "warcinfo"))
    http = F.struct("record_id", "kind", "target_uri", "date", "stated_digest", "first_line", "fields", "payload_bytes", "payload_sha256", "payload")
    # Ids of responses, and what records name. A response may itself name its request.
    named = others.select("record_id", F.explode("concurrent").alias("names"))
    by_response = heads.select(F.col("record_id").alias("capture_id"), F.explode("concurrent").alias("record_id"))
    direct = named.join(heads.select(F.col("record_id").alias("names")).distinct(), "names", "left_semi")
    direct = direct.select("record_id", F.col("names").alias("capture_id")).unionByName(by_response)
    open_names = named.join(heads.select(F.col("record_id").alias("names")), "names", "left_anti")
    through = open_names.join(direct.withColumnRenamed("record_id", "names"), "names").select("record_id", "capture_id")
    place = direct.unionByName(through).groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    # Without a response, what names the same record belongs together.
    fallback = F.coalesce(F.element_at("concurrent", 1), F.col("record_id"))
    placed = others.join(place, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", fallback))
    member = F.struct("record_id", "date", "first_line", "fields")
    kinds = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.to_json(member)))).alias(name) for k, name in (("request", "requests"), ("metadata", "metadata"))]
    members = placed.groupBy("capture_id").agg(*kinds)
    shape = "struct<record_id:string,date:string,first_line:string,fields:map<string,string>>"
    opened = [F.transform(name, lambda x: F.from_json(x, shape)).alias(name) for name in ("requests", "metadata")]
    responses = heads.select(F.col("record_id").alias("capture_id"), http.alias("response"))
    return responses.join(members.select("capture_id", *opened), "capture_id", "full_outer")


def read_captures(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The captures of all archives below a folder."""
    return assembled(saved(read_records(spark, path, payloads), "warc-records"))


def resolved(captures: DataFrame, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """row_id, record_type, payload_bytes, payload_digest, refers_to, where size and
    digest are those of the full payload, from the response that a revisit points at."""
    field = F.get(F.col("metadata"), 0)["fields"]
    flat = captures.where("response is not null").select(
        field["row-id"].try_cast("long").alias("row_id"),
        F.col("response.kind").alias("record_type"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.col("response.payload_sha256").alias("own_digest"),
        F.regexp_extract("response.stated_digest", "^sha256:([0-9a-f]{64})$", 1).alias("stated"),
    )
    flat = saved(flat, "warc-captures")
    revisits = flat.where("record_type = 'revisit'")
    there = flat.where((F.col("record_type") == "response") & (F.col("own_bytes") >= shared_bytes))
    there = there.groupBy(F.col("own_digest").alias("stated")).agg(F.min("row_id").alias("refers_to"), F.first("own_bytes").alias("payload_bytes"))
    shape = ["row_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    own = flat.where("record_type <> 'revisit'").withColumns(
        {"payload_bytes": F.col("own_bytes"), "payload_digest": F.col("own_digest"), "refers_to": F.lit(None).cast("long")}
    )
    found = revisits.join(there, "stated", "left").withColumn("payload_digest", F.col("stated"))
    return own.select(*shape).unionByName(found.select(*shape))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of a table into the shared folder, read them back and assemble them."""
    spark = prepare(pages.sparkSession)
    path = fresh_dir(spark, "warc")
    write_archives(pages, path)
    return resolved(read_captures(spark, path))
