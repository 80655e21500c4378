"""WARC archives with segmented records and revisits.

Writing. Every page is a record whose block is an HTTP response with the payload in chunked transfer
framing. Among records with equal payloads (of at least ``min_bytes``) the one with the largest page_id
is the response; the others are revisits that name it and carry no payload. A block longer than
``segment`` bytes is cut: the response record holds segment 1, continuation records the rest, the last
one with the total length. Spark's text writer writes a record per row with the two line ends that
close a record as separator, so archives are made on any file system, gzipped, under Spark's commit.

Reading. Archives are read as whole files of bounded size and cut into records by Content-Length.
Segments are grouped by the identifier of the record they began in, ordered by number, and checked
against the total length; the block's chunked framing is decoded and the payload's digest compared with
the one that the record states. A missing segment, a wrong length or digest stops the read.

Record ids are made of page_id and digest, so equal rows written twice are equal records and are read
back twice. Defined results: a null payload is empty; without a min_bytes bound empty payloads are
equal to each other too. Rows without a page_id are responses and nothing refers to them. Repeated
rows with the largest page_id are all responses. Extra columns are ignored; url may be null."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.scale import shared_folder

#: Bytes of a block in one record, and of a chunk of the transfer framing.
SEGMENT = 32_768
CHUNK = 8_192
#: Bytes of blocks in an archive file, at most.
FILE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 in upper-case base 32, by Spark's own functions: 40 bits of it at a time."""
    digest = F.sha1(data)
    eights = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_leaders(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, leader: the page that a revisit refers to, null for responses.
    Only digests that occur twice or more are joined back, with their leader alone."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    leaders = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n")
    )
    joined = rows.join(leaders, "digest", "left")
    return joined.withColumn("leader", F.when(F.col("page_id") < F.col("leader"), F.col("leader")))


def _chunks(payload: bytes) -> bytes:
    made = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(made) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    made, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].partition(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(made)
        made.append(body[at : at + size])
        at += size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        at += 2


def _record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    head += [f"{key.replace('_', '-')}: {value}" for key, value in fields.items() if value is not None]
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + END).encode() + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, leader: int | None, segment: int):
    """The records of a page."""
    name, http = f"urn:page:{page_id}:{digest}", "application/http;msgtype=response"
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest}"}
    top = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if leader is not None:
        yield _record(
            "revisit", name, top + b"Content-Length: %d\r\n\r\n" % len(payload), **common, Content_Type=http,
            WARC_Refers_To=f"<urn:page:{leader}:{digest}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        )
        return
    block = top + b"Transfer-Encoding: chunked\r\n\r\n" + _chunks(payload)
    cut = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record("response", name, cut[0], **common, Content_Type=http, WARC_Segment_Number=1 if len(cut) > 1 else None)
    for i, part in enumerate(cut[1:], 2):
        yield _record(
            "continuation", f"{name}:{i}", part, WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{name}>",
            WARC_Segment_Number=i, WARC_Segment_Total_Length=len(block) if i == len(cut) else None,
        )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write the pages (page_id, url, html) to a new folder of gzipped archives."""

    def made(batches):
        columns = ("page_id", "url", "payload", "digest", "leader")
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                out += records(*row, segment)
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    rows = with_leaders(pages, min_bytes).mapInArrow(made, "record binary")
    # a record is at most a segment, so a number of records bounds the archive that a reader holds
    writer = rows.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", max(1, FILE_BYTES // segment))
    writer.option("lineSep", END).option("compression", "gzip").text(folder)


def cut_archive(data: bytes):
    """(head fields, block) of the records of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + len(END)


def payload_of(block: bytes, digest: str) -> bytes:
    """The decoded payload of an HTTP response block, checked against the digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload doesn't have the digest that its record states")
    return payload


def _number(name: str) -> int | None:
    part = name.split(":")[2]
    return None if part == "None" else int(part)


PARSED = "record string, number int, total long, digest string, type string, refers_to long, url string, payload_bytes long, block binary"


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and on demand
    payload (null for revisits). Whole records are decoded where they are read; only segments and
    what describes records is shuffled."""

    def parsed(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for fields, block in cut_archive(zlib.decompress(content, 31)):
                    kind, name = fields["WARC-Type"], fields["WARC-Record-ID"][1:-1]
                    total, digest = fields.get("WARC-Segment-Total-Length"), fields.get("WARC-Payload-Digest", "")[5:]
                    row = {"record": name, "number": int(fields.get("WARC-Segment-Number", 0)), "total": total and int(total), "digest": digest or None, "type": kind, "url": fields.get("WARC-Target-URI")}
                    if kind == "revisit":
                        row["refers_to"] = _number(fields["WARC-Refers-To"][1:-1])
                        row["payload_bytes"] = int(block.partition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    elif kind == "continuation":
                        row |= {"record": fields["WARC-Segment-Origin-ID"][1:-1], "block": block}
                    elif row["number"]:
                        row["block"] = block
                    else:
                        payload = payload_of(block, digest)
                        row["payload_bytes"] = len(payload)
                        row["block"] = payload if with_payload else None
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PARSED.split(", ")])

    def joined(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                cut = sorted(row.pop("segments"), key=lambda x: x["number"])
                if cut[0]["number"]:
                    block = b"".join(x["block"] for x in cut)
                    if [x["number"] for x in cut] != list(range(1, len(cut) + 1)) or cut[-1]["total"] != len(block):
                        raise ValueError(f"segments of {row['record']} are missing")
                    payload = payload_of(block, row["payload_digest"])
                    row["payload_bytes"] = len(payload)
                    row["payload"] = payload if with_payload else None
                else:
                    row["payload"] = cut[0]["block"]
                row["page_id"] = _number(row.pop("record"))
            yield pa.RecordBatch.from_pylist(rows, schema=done)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, copies long, payload binary"
    done = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    rows = files.mapInArrow(parsed, PARSED)
    # equal rows written twice: one copy of each segment, and how often the record occurs
    once = rows.groupBy("record", "number").agg(
        F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in ("total", "digest", "type", "refers_to", "payload_bytes", "block", "url")]
    )
    first = F.col("number") <= 1
    whole = once.groupBy("record").agg(
        F.max("url").alias("url"),
        F.max("payload_bytes").alias("payload_bytes"),
        F.max("digest").alias("payload_digest"),
        F.max(F.when(first, F.col("type"))).alias("record_type"),
        F.max("refers_to").alias("refers_to"),
        F.max(F.when(first, F.col("copies"))).alias("copies"),
        F.collect_list(F.struct("number", "total", "block")).alias("segments"),
    )
    made = whole.mapInArrow(joined, schema)
    made = made.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "col")
    return made if with_payload else made.drop("payload")


def written_and_read(pages: DataFrame, min_bytes: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write pages to new archives in the shared folder and read them back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, min_bytes, segment)
    return read_archives(pages.sparkSession, folder)
