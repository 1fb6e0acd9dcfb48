"""WARC archives: writing captures as records, reading archives back, and assembling transactions.

A capture is written as a response (or a revisit of an equal payload), a request and a metadata record; the latter name
the response in WARC-Concurrent-To. Spark's text writer puts the two line breaks that end a record between its rows, so the files
are plain WARC. Reading parses each file by the records' content lengths. Assembly joins records through their concurrent-to
identifiers, whichever side names the other and also by way of the request, and gives one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.frames import small
from ticketlens.session import materialise

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST_REVISITED = 100


def _record_id(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("null")), digest).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line breaks behind it; headers that are null are left out."""
    lines = [F.lit("WARC/1.1" + _END)] + [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(_END)), F.lit("")) for k, v in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END * 2), block)


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Three rows ``value`` per row of ``pages``: response or revisit, request, metadata. Other columns are ignored.

    A null html is an empty payload, a null url gives no target; line breaks in it are percent-encoded. Of equal payloads
    of at least 100 bytes, the one with the smallest page_id is a response and the others revisit it; rows that repeat this page_id
    with this payload are responses too. A null page_id counts as larger than all others.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"), body.alias("body"),
        F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("size"),
    )
    equal = rows.filter(F.col("size") >= SMALLEST_REVISITED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    equal = materialise(equal.filter("n > 1").select(F.col("digest").alias("equal"), "first"), "warc-equal")
    joined = rows.join(small(equal, equal.count()), rows.digest == equal.equal, "left")
    revisit = F.col("equal").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    me = _record_id("response", F.col("page_id"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("X-Page-ID", F.col("page_id").cast("string"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    is_http = lambda kind: ("Content-Type", F.lit(f"application/http; msgtype={kind}"))
    main = F.when(
        revisit,
        _record([
            ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", me), *common, digest, ("WARC-Profile", F.lit(_PROFILE)),
            ("WARC-Refers-To", _record_id("response", F.col("first"), F.col("digest"))), is_http("response"),
        ], http),
    ).otherwise(_record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", me), *common, digest, is_http("response")], F.concat(http, F.col("body"))))
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    path = F.coalesce(F.nullif(F.try_parse_url("url", F.lit("FILE")), F.lit("")), F.lit("/"))
    request_id = _record_id("request", F.col("page_id"), F.col("digest"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", request_id), *common, ("WARC-Concurrent-To", me), is_http("request")],
        F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END * 2)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", F.col("page_id"), F.col("digest"))), *common,
         ("WARC-Concurrent-To", request_id), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payloadBytes: "), F.col("size").cast("string"), F.lit(_END)),
    )
    return joined.select(F.explode(F.array(main, request, metadata)).alias("value"))


def write(written: DataFrame, path: str, compression: str = "none", per_file: int = 9000) -> None:
    """Files of at most ``per_file`` records, plain or gzip; a reader holds one file at a time."""
    written.write.option("lineSep", _END * 2).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


_FIELDS = {
    "warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date", "warc-refers-to": "refers_to",
    "warc-payload-digest": "stated_digest", "x-page-id": "page_id", "content-type": "content_type",
}
_SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, stated_digest string, page_id string, "
    "content_type string, concurrent_to array<string>, payload_bytes bigint, payload_digest string, payload binary"
)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """Headers (names in lower case), concurrent-to identifiers and block of each record of an archive."""
    at, n = 0, len(data)
    while at < n:
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers, concurrent = {}, []
        for line in lines[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                concurrent.append(value)
            else:
                headers[name] = value
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > n:
            raise ValueError(f"a record is cut off at byte {n}")
        yield headers, concurrent, data[start:stop]
        at = stop + 4


def payload_of(content_type: str, block: bytes) -> bytes:
    """What follows the HTTP headers; the whole block of other records."""
    if not content_type.startswith("application/http"):
        return block
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b""


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives in a folder: its headers, length and SHA-256 of its payload, and the payload itself if asked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer().to_pybytes()
                rows = [
                    {**{ours: h.get(theirs) for theirs, ours in _FIELDS.items()}, "concurrent_to": c, **_measured(payload_of(h.get("content-type", ""), block), with_payload)}
                    for h, c, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                ]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _SCHEMA)


def _measured(payload: bytes, keep: bool) -> dict:
    return {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload if keep else None}


_ARROW = pa.schema([
    *[(k, pa.string()) for k in ("record_type", "record_id", "target_uri", "date", "refers_to", "stated_digest", "page_id", "content_type")],
    ("concurrent_to", pa.list_(pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def assemble(archive: DataFrame) -> DataFrame:
    """One row per response or revisit record: ``response``, ``request`` and ``metadata`` (structs, null if there is none), and how many
    requests and metadata records belong to it; of several the one with the smallest record id is given, the others remain in
    ``archive``. Records may name each other in either direction, metadata also by way of the request.

    ``response`` of a revisit has the length and digest of the payload that it refers to; if that record is missing, the stated
    digest and a null length. ``refers_to_page`` is its page. Responses with equal record id get equal companions, each its
    own row. Records of other types and those that belong to no response give no row.
    """
    own = [c for c in archive.columns if c != "concurrent_to"]
    anchors = archive.filter(F.col("record_type").isin("response", "revisit"))
    others = archive.filter(F.col("record_type").isin("request", "metadata")).select("record_type", "record_id", "concurrent_to", F.struct(*own).alias("r"))

    named = others.select("record_type", "record_id", "r", F.explode("concurrent_to").alias("anchor"))
    naming = anchors.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("anchor"))
    back = others.join(naming.distinct(), "record_id").select("record_type", "record_id", "r", "anchor")
    links = named.union(back).distinct()
    requests = links.filter("record_type = 'request'")
    via = requests.select(F.col("record_id").alias("via"), F.col("anchor").alias("far")).distinct()
    notes = links.filter("record_type = 'metadata'").join(via, F.col("anchor") == F.col("via"), "left")
    notes = notes.select("r", "record_id", F.coalesce("far", "anchor").alias("anchor")).distinct()

    def companions(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("anchor").alias(f"{name}_of")).agg(
            F.min_by("r", "record_id").alias(name), F.count("*").alias(f"n_{name}")
        )

    request, metadata = companions(requests, "request"), companions(notes, "metadata")
    target = anchors.filter("record_type = 'response'").groupBy(F.col("record_id").alias("target")).agg(
        F.min_by(F.struct("payload_bytes", "payload_digest", "page_id"), "page_id").alias("t")
    )
    is_revisit = F.col("record_type") == "revisit"
    revisits = anchors.filter(is_revisit).join(target, F.col("refers_to") == F.col("target"), "left").withColumns({
        "payload_bytes": F.col("t.payload_bytes"),
        "payload_digest": F.coalesce("t.payload_digest", F.regexp_extract("stated_digest", "^sha256:([0-9a-f]{64})$", 1)),
        "refers_to_page": F.col("t.page_id"),
    }).drop("target", "t")
    plain = anchors.filter(~is_revisit).withColumn("refers_to_page", F.lit(None).cast("string"))
    rows = plain.unionByName(revisits).select("record_id", F.struct(*own).alias("response"), "refers_to_page")
    rows = rows.join(request, F.col("record_id") == F.col("request_of"), "left").join(metadata, F.col("record_id") == F.col("metadata_of"), "left")
    count = lambda name: F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}")
    return rows.select("response", "request", "metadata", "refers_to_page", count("request"), count("metadata"))


def capture_digests(captures: DataFrame) -> DataFrame:
    return captures.select(
        F.col("response.page_id").cast("bigint").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.col("refers_to_page").cast("bigint").alias("refers_to"), F.col("request.record_id").isNotNull().alias("has_request"),
        F.col("metadata.record_id").isNotNull().alias("has_metadata"),
    )


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {SMALLEST_REVISITED} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {SMALLEST_REVISITED} AND page_id <> first THEN first END AS refers_to, true AS has_request, true AS has_metadata
FROM f
"""
