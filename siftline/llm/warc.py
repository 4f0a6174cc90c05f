"""WARC archives written and read, and transactions assembled from their records.

Writing: every page gives a request, a response (or a revisit of an earlier capture with an equal payload)
and a metadata record; the latter's and the request's WARC-Concurrent-To names the response's record. Spark's
text writer puts the records into gzipped files on any file system Spark can reach; a record's closing
blank lines are the writer's line separator. Files are kept small by rows (``FILE_RECORDS``).

Reading: whole files as binary rows; a worker walks through one file's records with a gzip stream.

Assembly: records meet by the capture they belong to. A request or metadata record names the response
directly, or names a record that does (two hops); one grouping by that identifier gives one nested row for
each capture. Payload digests are SHA-1 in base32. A revisit's WARC-Refers-To is joined to the response that
bears that identifier.

Defined cases: a null html is an empty payload; empty payloads are deduplicated like others; rows equal in
page_id and payload are one capture that is returned as often as it was written; a null page_id is
never a response for others; a null url is empty. Records with broken headers end the reading of their file
and are counted in ``broken``. Long payloads are single values of a row; a file holds FILE_RECORDS records at most.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import _work

#: Records of one archive file.
FILE_RECORDS = 12_000
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:capture:{'null' if page_id is None else page_id}:{digest[:12]}:{kind}>"


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": DATE} | fields | {"Content-Length": str(len(block))}
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block


def target(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def records_of(page_id: int | None, url: str | None, payload: bytes, original: int | None) -> list[bytes]:
    """Request, response or revisit, and metadata of one page; ``original``: the page whose capture it revisits."""
    digest = payload_digest(payload)
    main = "response" if original is None else "revisit"
    own, uri = urn(page_id, digest, main), target(url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {"WARC-Record-ID": own, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if original is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(original, digest, "response")}
    about = f"page-id: {'' if page_id is None else page_id}\r\npayload-length: {len(payload)}\r\n".encode()
    ask = b"GET " + uri.encode() + b" HTTP/1.1\r\n\r\n"
    return [
        record("request", {"WARC-Record-ID": urn(page_id, digest, "request"), "WARC-Concurrent-To": own, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=request"}, ask),
        record(main, head, http + (payload if original is None else b"")),
        record("metadata", {"WARC-Record-ID": urn(page_id, digest, "metadata"), "WARC-Concurrent-To": own, "WARC-Target-URI": uri, "Content-Type": "application/warc-fields"}, about),
    ]


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``; payloads under ``least`` bytes are never revisits."""
    _work.prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    equal = rows.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("times"))
    equal = _work.materialise(equal.where("times > 1 and original is not null").select("sha", "n", "original"), "equal-payloads")
    rows = rows.join(equal, ["sha", "n"], "left").select("page_id", "url", "payload", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("original"))
    fields = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in zip(*_work.columns(batch, "page_id", "url", "payload", "original"), strict=True):
                made += records_of(*row)
            yield _work.out(fields, [made])

    raw = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def walk(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of the records of one archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should start")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, block_bytes long, payload_bytes long, page_id long, payload binary, broken boolean"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under ``path``; of responses the digest and length are taken of the bytes read, not of headers."""
    _work.prepare(spark)
    fields = pa.schema([
        *[(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "payload_digest")],
        *[(n, pa.int64()) for n in ("block_bytes", "payload_bytes", "page_id")], ("payload", pa.binary()), ("broken", pa.bool_()),
    ])

    def parsed(head: dict[str, str], block: bytes) -> tuple:
        kind, length, page_id, payload = head.get("warc-type"), None, None, None
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            digest, length = payload_digest(payload), len(payload)
        elif kind == "metadata":
            about = dict(line.split(": ", 1) for line in block.decode("utf-8", "replace").split("\r\n") if ": " in line)
            length = int(about["payload-length"]) if about.get("payload-length", "").isdigit() else None
            page_id = int(about["page-id"]) if about.get("page-id", "").lstrip("-").isdigit() else None
        return head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, len(block), length, page_id, payload if payloads else None, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (content,) in zip(*_work.columns(batch, "content"), strict=True):
                stream = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows, size = [], 0
                try:
                    for head, block in walk(stream):
                        rows.append(parsed(head, block))
                        size += len(block) if payloads else 100
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield _work.out(fields, [[r[i] for r in rows] for i in range(len(fields))])
                            rows, size = [], 0
                except (ValueError, KeyError, OSError, EOFError):
                    rows.append((*[None] * 10, True))
                yield _work.out(fields, [[r[i] for r in rows] for i in range(len(fields))])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response (or revisit), request and metadata joined by concurrent-to identifiers.

    Of several requests or metadata records of a capture the one of least record_id is taken.
    """
    sound = records.where("not broken and record_id is not null")
    body = F.struct("record_id", "record_type", "refers_to", "target_uri", "payload_digest", "block_bytes", "payload_bytes", "page_id", "payload")
    rows = sound.select("record_id", "record_type", "concurrent_to", body.alias("body"))
    # A record that is concurrent to a request or metadata record belongs to what that one is concurrent to.
    hops = rows.where("concurrent_to is not null and record_type in ('request', 'metadata')").select(F.col("record_id").alias("concurrent_to"), F.col("concurrent_to").alias("next")).distinct()
    mains = rows.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture"), "record_type", "body")
    others = rows.where("record_type in ('request', 'metadata') and concurrent_to is not null").join(hops, "concurrent_to", "left")
    others = others.select(F.coalesce("next", "concurrent_to").alias("capture"), "record_type", "body")

    def of(*kinds: str) -> Column:
        return F.min_by("body", F.when(F.col("record_type").isin(*kinds), F.col("body.record_id")))

    grouped = mains.unionByName(others).groupBy("capture").agg(
        of("response", "revisit").alias("response"), of("request").alias("request"), of("metadata").alias("metadata"), F.count_if(F.col("record_type").isin("response", "revisit")).alias("times"))
    grouped = grouped.where("times > 0")
    return grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("capture", "response", "request", "metadata")


def resolved(captures: DataFrame) -> DataFrame:
    """capture, page_id, payload_bytes, payload_digest, record_type, refers_to (the page of the response that a revisit's
    WARC-Refers-To names, looked up among ``captures``; null where the archives don't hold that response)."""
    rows = captures.select(
        "capture",
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", F.col("response.refers_to")).alias("named"),
    )
    rows = _work.materialise(rows, "captures")
    whole = rows.where("record_type = 'response'").join(rows.where("named is not null").select(F.col("named").alias("capture")).distinct(), "capture", "left_semi")
    whole = whole.groupBy(F.col("capture").alias("named")).agg(F.max("page_id").alias("refers_to"))
    first, later = rows.where("named is null").withColumn("refers_to", F.lit(None).cast("long")), rows.where("named is not null").join(whole, "named", "left")
    return later.select(*first.columns).unionByName(first).drop("named")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back."""
    spark = pages.sparkSession
    path = _work.new_path(spark, "archives")
    write(pages, path)
    return resolved(assemble(read(spark, path, payloads=False))).drop("capture")
