"""WARC archives of pages: written with revisit records for equal payloads, read back and assembled into captures."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"


def record_id(kind: str, page_id: Column, url: Column, digest: Column, row: Column) -> Column:
    """The identifier of a page row's record of a kind: the same in every run over the same table."""
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("null")), digest, row.cast("string"), url))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def _record(kind: str, name: Column, block: Column, kind_of_block: str, *fields: tuple[str, Column]) -> Column:
    """One record but for its last line end; a field whose value is null is left out."""
    head = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), name, F.lit(CRLF)]
    for field, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{field}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*head, F.lit(f"Content-Type: {kind_of_block}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_bytes: int = 1000, pages_each: int = 2000) -> None:
    """Writes a request, a response or revisit, and a metadata record per page row to gzip files below path.

    Payloads are the html in UTF-8, null as empty. Of pages with equal payloads of least_bytes or more
    those of the largest id have responses, the others revisit the first of these. Rows without an id
    revisit too; if no row has one, all have responses. A repeated row has records of its own: rows are
    told apart by their places in the table, so pages is a table or a plan that reads the same twice.
    Digests alone are grouped and joined; texts move once, to partitions of the size that adaptive execution
    is set to, and files of pages_each rows at most. A line end in a url becomes a space, no url is an empty one.
    """
    page = pages.select(
        F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"),
    )
    page = page.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    light = page.select("id", "url", "row", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    # the first row of the largest id, of each payload that several rows have
    first = light.groupBy("digest").agg(F.max(F.struct("id", (-F.col("row")).alias("minus"), "url")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    marks = light.join(first, "digest").where("NOT id <=> kept.id").groupBy("id", "digest").agg(F.first("kept").alias("kept"))
    marks = marks.select(F.col("id").alias("of"), F.col("digest").alias("as"), "kept")
    joined = page.join(marks, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("as")), "left")

    own = F.col("id"), F.col("url"), F.col("digest"), F.col("row")
    main = F.when(F.col("kept").isNull(), record_id("response", *own)).otherwise(record_id("revisit", *own))
    origin = record_id("response", F.col("kept.id"), F.col("kept.url"), F.col("digest"), -F.col("kept.minus"))
    when, target = ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))
    payload = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    request = _record("request", record_id("request", *own), F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF * 2}")), "application/http;msgtype=request", when, target, ("WARC-Concurrent-To", main))
    response = _record("response", main, F.concat(F.lit(HTTP_HEAD), F.col("html")), "application/http;msgtype=response", when, target, payload)
    revisit = _record("revisit", main, F.lit(HTTP_HEAD), "application/http;msgtype=response", when, target, payload, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", F.col("kept.url")))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-length: "), F.octet_length("html").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", record_id("metadata", *own), about, "application/warc-fields", when, target, ("WARC-Concurrent-To", main))
    capture = F.concat(request, F.lit(CRLF), F.when(F.col("kept").isNull(), response).otherwise(revisit), F.lit(CRLF), metadata)
    # a line of the text writer is a capture; the line separator is the last record's last line end
    joined.select(capture.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", pages_each).mode("overwrite").text(path)


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of a plain file, in steps."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    engine = zlib.decompressobj(31)
    while at < len(view):
        part = engine.decompress(view[at : at + step])
        at += min(step, len(view) - at)
        yield part
        while engine.eof:
            at -= len(engine.unused_data)
            if at >= len(view) or view[at : at + 2] != b"\x1f\x8b":
                return
            engine = zlib.decompressobj(31)
            part = engine.decompress(view[at : at + step])
            at += min(step, len(view) - at)
            yield part
    if not engine.eof:
        raise ValueError("the gzip file ends inside a member")


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record; lengths alone tell where a block ends. At most one record is held.

    What is no record, a record without a length and one that the file cuts short are errors of their own.
    """
    chunks, held, buffer = iter(chunks), True, bytearray()

    def more() -> bool:
        nonlocal held
        part = next(chunks, None)
        held = part is not None
        buffer.extend(part or b"")
        return held

    while True:
        while buffer[:2] == b"\r\n" or (len(buffer) < 2 and more()):  # what ends the record before
            if buffer[:2] == b"\r\n":
                del buffer[:2]
        if not buffer:
            return
        looked = 0
        while (end := buffer.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(buffer) - 3)
            if not more():
                raise ValueError("the file ends inside a record's head")
        lines = buffer[:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record, but {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"record {fields.get('warc-record-id')} has no Content-Length")
        start, size = end + 4, int(fields["content-length"])
        while len(buffer) < start + size:
            if not more():
                raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        block = bytes(buffer[start : start + size])
        del buffer[: start + size]
        yield fields, block


RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, stated_digest string, payload_digest string, payload_bytes long, fields map<string,string>"


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record below path. Digest and length are those of the HTTP payload that the record holds.

    A file is inflated in steps, and a record at a time is held.
    """
    schema = RECORD + ", payload binary" * with_payload
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * with_payload

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in parse(inflated(content)):
            kind, said, payload = fields.get("warc-type"), {}, None
            if kind in ("response", "revisit"):
                payload = block.partition(b"\r\n\r\n")[2]
            elif kind == "metadata":
                said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if k}
            digest = fields.get("warc-payload-digest")
            row = (kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), payload if payload is None else hashlib.sha1(payload).hexdigest(), None if payload is None else len(payload), list(said.items()))
            yield row + (payload,) * with_payload

    def sliced(found: Iterator[tuple], most_rows: int = 1000, most_bytes: int = 4_000_000) -> Iterator[list[tuple]]:
        part, size = [], 0
        for row in found:
            part.append(row)
            size += len(row[-1] or b"") if with_payload else 0
            if len(part) >= most_rows or size >= most_bytes:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in sliced(rows(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (response, request, metadata) as nested records, n_requests, n_metadata.

    A request or metadata record belongs to the response or revisit that its concurrent-to identifier
    names. Of several, the one of the least identifier is shown. Records that no response claims have
    a row with a null response. The minima combine before the shuffle, so no group is held whole.
    """
    whole = F.struct("record_id", *[c for c in records.columns if c not in ("record_id", "fields")], F.map_entries("fields").alias("fields"))
    is_main = F.col("type").isin("response", "revisit")
    keyed = records.select("type", F.when(is_main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture"), whole.alias("r"))
    of = lambda what: F.min(F.when(what, F.col("r")))
    request, metadata = F.col("type") == "request", F.col("type") == "metadata"
    return keyed.groupBy("capture").agg(of(F.col("type").isin("response", "revisit")).alias("response"), of(request).alias("request"), of(metadata).alias("metadata"), F.count_if(request).alias("n_requests"), F.count_if(metadata).alias("n_metadata"))


def field(record: str, name: str) -> Column:
    """A field of a record's block of fields."""
    return F.element_at(F.map_from_entries(F.col(f"{record}.fields")), name)


def with_origins(captures: DataFrame, named: dict[str, Column]) -> DataFrame:
    """captures with columns of the capture whose response a revisit refers to by identifier; null for responses.

    captures is read twice: pass a checkpoint or a table. The revisits of one response may be very many; what
    meets them in the join is one row a response.
    """
    is_revisit = F.coalesce(F.col("response.type") == "revisit", F.lit(False))
    origins = captures.where(F.col("response.type") == "response").select(F.col("response.record_id").alias("_origin"), *[c.alias(n) for n, c in named.items()])
    kinds = {f.name: f.dataType for f in origins.schema}
    others = captures.where(~is_revisit).select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in named])
    return captures.where(is_revisit).join(origins, F.col("response.refers_to") == F.col("_origin"), "left").drop("_origin").unionByName(others)
