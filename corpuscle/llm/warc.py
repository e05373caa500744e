"""WARC archives: writing, segmentation, revisits, and reassembly on reading.

Archives are concatenated WARC/1.1 records under gzip, written by Spark's own
writer, so that they may lie in any store Spark knows. A response block is an
HTTP message whose body has chunked transfer framing. A block beyond the segment
size is cut: the first segment is the response record, each further one a
continuation record that names the origin, its segment number and, on the last,
the total length.

Reading parses each archive once, plain or gzip, by the records' Content-Length.
Whole records are decoded where they are read; segments are grouped by origin,
ordered by number, their total length verified, and decoded.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, small_batches

SEGMENT = 1 << 16
HTTP_CHUNK = 1 << 13
REVISIT_FROM = 100
#: Records of an archive: with segments of 64 KiB, a reading task holds 64 MB of them at most.
PER_FILE = 1024
_SPACE = uuid.UUID("6f3f2a52-8f1e-5d0b-9a57-0c9f3f0f3a11")
_DATE = "2024-01-01T00:00:00Z"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: str | None, digest: str, url: str | None, copy: int = 1, segment: int = 1) -> str:
    """One ID for each row and segment, the same on every run; copy counts the rows that are equal in all else."""
    named = "/".join("-" if x is None else quote(x, safe="") for x in (page, url))
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{named}/{digest}/{copy}/{segment}')}>"


def chunked(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError if it is broken or cut short."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block  # the writer adds the two line ends


def _clean(url: str | None) -> str:
    return "".join(c for c in (url or "") if c >= " ").strip()


def page_records(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[str, str | None] | None, segment: int, copy: int = 1) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations.

    refers_to: the page and address of the response that holds the payload. Page
    IDs are percent-encoded, so that any text comes back as it was; a null one
    has no field.
    """
    own = lambda k=1: record_id(page, digest, url, copy, k)
    paged = [] if page is None else [("X-Page-ID", quote(page, safe=""))]
    named = [("WARC-Record-ID", own()), ("WARC-Date", _DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), *paged]
    if refers_to is not None:
        first, at = refers_to
        same = [("WARC-Refers-To", record_id(first, digest, at)), ("X-Refers-To-Page-ID", quote(first, safe="")), ("WARC-Profile", _SAME)]
        yield _record([("WARC-Type", "revisit"), *named, *same, ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        kind = [("WARC-Type", "response"), *named, ("Content-Type", "application/http; msgtype=response")]
        if k > 1:
            kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", own(k)), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own()), *paged]
        if len(cuts) > 1:
            kind.append(("WARC-Segment-Number", str(k)))
            if k == len(cuts):
                kind.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(kind, block[at : at + segment])


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record; ValueError where it is no WARC."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        block = archive[end + 4 : end + 4 + n]
        if len(block) != n or archive[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + n


def decode(block: bytes) -> bytes:
    """The payload of a whole HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _with_copies(rows: DataFrame, pages: DataFrame, scratch: Scratch, id_col: str) -> DataFrame:
    """rows with `copy`: 1, or the running number among rows equal in page, address and payload.

    Only rows whose ID occurs again are dealt out: they are counted, and a counted
    row is written out as often as it was there.
    """
    again = pages.groupBy(F.col(id_col).cast("string").alias("page")).agg(F.count("*").alias("n")).filter("n > 1").select("page", F.lit(True).alias("again"))
    again = scratch.keep(again, "again")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(1).cast("long"))
    hashed = lambda t: t.withColumn("k3", F.crc32(F.coalesce(F.col("page"), F.lit("")).cast("binary")))
    near = hashed(again).withColumnRenamed("page", "page_").withColumnRenamed("k3", "k3_")
    near = F.broadcast(near) if scratch.small(again) else near
    x = hashed(rows).join(near, F.col("page").eqNullSafe(F.col("page_")) & (F.col("k3") == F.col("k3_")), "left").drop("page_", "k3", "k3_")
    once = x.filter("again is null").drop("again").withColumn("copy", F.lit(1).cast("long"))
    # a null address is none: the addresses of equal rows are compared null-safe by the grouping
    many = x.filter("again").drop("again").groupBy(*[c for c in rows.columns if c != "payload"]).agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).repartition("page", "digest", "copy")
    return once.unionByName(many.select(*once.columns))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Write a record (and its continuations) per row of pages to archives under path.

    Of rows with equal payloads of REVISIT_FROM bytes or more, the one with the
    smallest id is the response and the others are revisits; shorter ones are all
    responses, and so are rows that share the smallest id. A file holds at most
    per_file records of at most segment bytes and heads, which bounds what a
    reading task loads. Null html is an empty payload.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = rows.filter((F.octet_length("payload") >= REVISIT_FROM) & F.col("id").isNotNull())
    # the second key makes the join deal out both sides anew, so that a hot payload's rows can be split
    first = rows.filter(F.octet_length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.crc32(F.col("digest").cast("binary"))).alias("k2")).filter("n > 1").drop("n")
    least = long.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"))
    first = scratch.keep(first.join(least, "digest").select("digest", F.col("first.id").alias("first"), F.col("first.url").alias("first_url"), "k2"), "first")
    first = F.broadcast(first) if scratch.small(first) else first
    rows = rows.withColumn("k2", F.crc32(F.col("digest").cast("binary"))).join(first, ["digest", "k2"], "left").drop("k2")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    rows = rows.select("page", "url", "payload", "digest", refers.alias("to"), F.col("first_url").alias("to_url"))
    rows = _with_copies(rows, pages, scratch, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):  # a record batch a page: its records are all that is held
                page, url, body, digest, to, to_url, copy = (b.column(k)[r].as_py() for k in range(7))
                refers = None if to is None else (to, to_url)
                yield pa.RecordBatch.from_arrays([pa.array(list(page_records(page, url, body, digest, refers, segment, copy)), pa.binary())], names=["value"])

    out = rows.select("page", "url", "payload", "digest", "to", "to_url", "copy").mapInArrow(run, "value binary")
    # Spark's text writer passes bytes through; the line end is the record's
    out.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """(page, record_type, payload, digest, refers_to) of every response and revisit under path.

    payload is null for a revisit. A broken record, a missing segment, a total
    length that does not add up or broken framing fails the read. The archives are
    parsed once, into a table in the shared folder, apart for whole records and
    segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "number", "total", "page", "kind", "body", "digest", "refers_to", "cut"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.bool_()]
        for b in batches:
            for r in range(b.num_rows):
                cols: list[list] = [[] for _ in names]
                held = 0
                archive = b.column(0)[r].as_py()
                for f, block in parse(gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive):
                    kind, number = f["warc-type"], int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    body = block if number is not None else decode(block) if kind == "response" else None
                    row = (f.get("warc-segment-origin-id", f["warc-record-id"]), number, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None)
                    row += (_plain(f.get("x-page-id")), kind, body, f.get("warc-payload-digest", "").removeprefix("sha256:") or None, _plain(f.get("x-refers-to-page-id")), number is not None)
                    for c, v in zip(cols, row):
                        c.append(v)
                    held += len(block)
                    if held > 8 << 20:  # what goes back to the JVM at a time
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
                        cols, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    scratch = scratch or Scratch(spark, "read")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "origin string, number long, total long, page string, kind string, body binary, digest string, refers_to string, cut boolean"
    records = scratch.keep(files.mapInArrow(run, schema), "records", by="cut")
    whole = records.filter("not cut").select("page", F.col("kind").alias("record_type"), F.col("body").alias("payload"), "digest", "refers_to")
    # one page's segments make a group: no larger than the page
    parts = records.filter("cut").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "body"))).alias("parts"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("number") == 1, F.struct("page", "digest"))).alias("first"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                segments = b.column(1)[r].as_py()
                block = b"".join(s["body"] for s in segments)
                if [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or len(block) != b.column(2)[r].as_py():
                    raise ValueError(f"segments of {b.column(0)[r].as_py()} are missing or their length is wrong")
                out.append(decode(block))
            first = b.column(3)
            yield pa.RecordBatch.from_arrays([first.field("page"), pa.array(["response"] * b.num_rows), pa.array(out, pa.binary()), first.field("digest"), pa.nulls(b.num_rows, pa.string())], names=["page", "record_type", "payload", "digest", "refers_to"])

    return whole.unionByName(parts.mapInArrow(join, "page string, record_type string, payload binary, digest string, refers_to string"))


def _plain(field: str | None) -> str | None:
    return None if field is None else unquote(field)


def archive_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> DataFrame:
    """Write pages to archives and read them back.

    Per row: id_col, payload_bytes, payload_digest, record_type, refers_to. A
    revisit's payload_bytes and digest are those of the response it names, which
    the read payload gives: the response of that id whose payload has the digest
    that the revisit carries. Null and empty html is an empty payload, a response.
    A null id is written and read as null and is never the response that others
    revisit. Rows with equal ids, and equal rows, each give a record; text ids
    come back as they were, empty ones and outer blanks included; an empty
    table gives no rows; other columns are not archived.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    scratch = Scratch(spark, "archive")
    small_batches(spark)
    at = scratch.path("warc")
    write_archives(pages, at, id_col=id_col, url_col=url_col, html_col=html_col, segment=segment)
    read = read_archives(spark, at, scratch)
    read = read.select("page", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"))
    read = scratch.keep(read, "read")
    wrong = read.filter("record_type = 'response' and digest <> sha")
    if not wrong.isEmpty():
        raise ValueError(f"a payload read back differs from what was written: page {wrong.first().page}")
    # only responses that revisits name: one row each, so that a hot one's revisits can be split
    named = read.filter("refers_to is not null").groupBy("refers_to", "digest").agg(F.max(F.crc32(F.col("digest").cast("binary"))).alias("k2"))
    named = read.filter("record_type = 'response'").select(F.col("page").alias("refers_to"), "digest", F.col("n").alias("n1"), F.col("sha").alias("sha1")).join(named, ["refers_to", "digest"]).dropDuplicates(["refers_to", "digest"])
    named = scratch.keep(named, "named")
    near = F.broadcast(named) if scratch.small(named) else named
    out = read.withColumn("k2", F.crc32(F.col("digest").cast("binary"))).join(near, ["refers_to", "digest", "k2"], "left")
    return out.select(F.col("page").cast(kind).alias(id_col), F.coalesce("n", "n1").alias("payload_bytes"), F.coalesce("sha", "sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
