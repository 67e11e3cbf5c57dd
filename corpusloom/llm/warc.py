"""WARC archives: written from pages with revisit records, and read back with segments put together again.

Writing: pages with equal payloads of ``least_bytes`` bytes or more are one response, that of the largest id,
and revisits that refer to it. A block (HTTP header and body in chunked transfer framing) longer than
``segment_bytes`` is cut into a response segment and continuation records. Each record is a gzip member of its own.
Spark's text writer stores them, a member a line, with an empty gzip member as line separator: so files lie wherever
Spark can write, any of them decompresses as a whole or from any member on, and none holds more than ``file_records``
records. Every record has an identifier that no other has, equal pages included; a task's records begin with a
``warcinfo`` record. The page's id stands in an extension field, and of a revisit also the response's.

Reading: archives of this writer are read by their separators, so a file can be split; other archives (``.gz``,
``.warc``) are streamed by the marks that records begin with and checked by their Content-Length, so a task holds one
record, not a file. Segments are grouped by the origin's identifier, ordered by segment number and joined if they are
complete and of the stated total length; then the chunked framing is decoded. Whole records need no shuffle; only
segments are grouped, and no group is larger than a record.

Defined results: a null payload is empty; null ids are responses, never revisits; rows with equal id and
payload are records of their own; an empty table gives no record; other columns play no part. A record that lacks a
part, breaks off, has another total length, wrong framing or another digest than it states comes back with a null
payload, null payload_bytes and ``intact`` false. The last record of a part of an uncompressed archive that Spark
splits is whole unless its payload holds a record's mark.
"""

import base64
import datetime
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import checkpointed, row_udf

LEAST_BYTES, SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 1000, 16_384, 4096, 2000

END = b"\r\n\r\n"
MARK = b"WARC/1."
#: A gzip member without content.
SEPARATOR = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_ARCHIVES = {"encoding": "ISO-8859-1", "lineSep": SEPARATOR.decode("latin-1")}


def member(record: bytes) -> bytes:
    """The record as a gzip member."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def _head(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    return "\r\n".join([first, *[f"{k}: {v}" for k, v in fields if v is not None]]).encode("utf-8", "replace") + END


def record(kind: str, identifier: str, date: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    return _head("WARC/1.1", [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]) + block + END


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + chunk_bytes] for i in range(0, len(payload), chunk_bytes)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def safe_uri(url: str | None) -> str | None:
    """The URL without signs that would end a header line."""
    return None if url is None else "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def page_records(own: str, date: str, page, url: str | None, payload: str | None, digest: str, response=None, response_url: str | None = None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """The records of one page under the identifier ``own``: a revisit of ``response`` unless that is null."""
    body = (payload or "").encode("utf-8", "replace")
    target = ("WARC-Target-URI", safe_uri(url))
    common = [target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", None if page is None else str(page))]
    kind = ("Content-Type", "application/http;msgtype=response")
    if response is not None:
        block = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))])
        refers = [("WARC-Refers-To-Target-URI", safe_uri(response_url)), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", str(response)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record("revisit", own, date, [*common, *refers, kind], block)]
    block = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Transfer-Encoding", "chunked")]) + chunked(body, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record("response", own, date, [*common, kind, ("WARC-Segment-Number", "1" if len(parts) > 1 else None)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        total = str(len(block)) if i == len(parts) else None
        out.append(record("continuation", f"{own[:-1]}-{i}>", date, [target, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i)), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_pages(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = LEAST_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    file_records: int = FILE_RECORDS,
    date: str | None = None,
) -> None:
    """Write the pages' records under ``path``, dated now or ``date``.

    Payloads that occur twice or more are found by a sum per digest; the pages then meet these digests in an
    equality join that adaptive execution splits where one payload has very many copies.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    job = uuid.uuid4()
    text = F.coalesce(F.col(payload), F.lit(""))
    own = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), text.alias("payload"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("bytes"))
    largest = own.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.when(F.col("page").isNotNull(), F.struct("page", "url"))).alias("top"), F.min("page").alias("smallest"))
    largest = largest.where(F.col("smallest") < F.col("top.page")).select("digest", F.col("top.page").alias("largest"), F.col("top.url").alias("largest_url"))
    largest = checkpointed(largest)  # a join with the sums themselves would keep their partitions, and none of them could be split
    response = F.when(F.col("page") < F.col("largest"), F.col("largest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), itertools.count()

        def identifier(what: object) -> str:
            return f"<urn:uuid:{uuid.uuid5(job, f'{part}:{what}')}>"

        info = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
        first = [record("warcinfo", identifier("info"), date, [("Content-Type", "application/warc-fields")], info)]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            values = first + [r for cells in zip(*columns, strict=True) for r in page_records(identifier(next(row)), date, *cells, segment_bytes, chunk_bytes)]
            first = []
            yield pa.RecordBatch.from_arrays([pa.array(map(member, values), pa.binary())], names=["value"])

    rows = own.join(largest, "digest", "left").select("page", "url", "payload", "digest", response.alias("response"), F.when(response.isNotNull(), F.col("largest_url")).alias("response_url"))
    members = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.mode("overwrite").options(**_ARCHIVES).option("compression", "none").option("maxRecordsPerFile", file_records).text(path)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields (names in lower case) and block of each record of an archive that was cut before each ``MARK``.

    What stands before the first mark isn't read. A payload may hold marks itself: pieces are joined until the stated
    length is there. A record that breaks off, or states no length, has no block.
    """
    pieces = iter(pieces)
    next(pieces, None)
    for piece in pieces:
        while (end := piece.find(END)) < 0 and (more := next(pieces, None)) is not None:
            piece += MARK + more
        fields = {}
        for line in piece[: end if end >= 0 else len(piece)].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        stated = fields.get("content-length", "")
        if end < 0 or not stated.isdecimal():
            yield fields, None
            continue
        last, parts, size = end + 4 + int(stated), [piece], len(piece)
        while size < last and (more := next(pieces, None)) is not None:
            parts += [MARK, more]
            size += len(MARK) + len(more)
        yield fields, b"".join(parts)[end + 4 : last] if size >= last else None


def unpacked(members: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The records of gzip members, one each; bytes that aren't one, or hold no record, are left out."""
    for squeezed in members:
        try:
            whole = zlib.decompress(squeezed, 31)
        except zlib.error:
            grown = zlib.decompressobj(31)
            try:
                whole = grown.decompress(squeezed)  # a member that breaks off still says whose record it was
            except zlib.error:
                whole = b""
        yield from parse(whole.split(MARK))


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of an HTTP message."""
    head, _, body = block.partition(END)
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, body


def unchunked(body: bytes) -> bytes | None:
    """The payload from chunked transfer framing; None if the framing breaks off or is wrong."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if n < 0 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def hex_digest(stated: str | None) -> str | None:
    """A stated SHA-1 (hexadecimal or base 32, with or without its name) as lower-case hexadecimal; None if there is none."""
    bare = (stated or "").removeprefix("sha1:")
    if len(bare) == 32:
        try:
            return base64.b32decode(bare, casefold=True).hex()
        except ValueError:
            return None
    return bare.lower() if len(bare) == 40 else None


def payload_of(block: bytes | None, digest: str | None) -> bytes | None:
    """The block's payload, if it's whole and has the digest, where one is stated."""
    if block is None:
        return None
    fields, body = http_parts(block)
    payload = unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
    return None if payload is None or (digest and hashlib.sha1(payload).hexdigest() != digest) else payload


def reassembled(segments: list[dict], digest: str | None = None) -> bytes | None:
    """The payload of a record's segments (number, total, block), if all is there."""
    parts = {s["number"]: s for s in segments}
    if sorted(parts) != list(range(1, len(parts) + 1)) or any(s["block"] is None for s in parts.values()):
        return None
    block = b"".join(parts[k]["block"] for k in sorted(parts))
    return payload_of(block, digest) if parts[len(parts)]["total"] == len(block) else None


RECORD = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("record_id", "record_type", "url", "refers_to_id", "page", "refers_to_page", "payload_digest")],
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("intact", T.BooleanType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("total", T.LongType()),
    ]
)


def _number(stated: str | None) -> int | None:
    return int(stated) if stated and stated.isdecimal() else None


def _described(fields: dict[str, str], block: bytes | None) -> tuple:
    """A row of RECORD; of a segment, payload is the segment's block."""
    kind, digest = fields.get("warc-type"), hex_digest(fields.get("warc-payload-digest"))
    own, refers = (fields.get(n, "").strip("<>") or None for n in ("warc-record-id", "warc-refers-to"))
    known = (kind, fields.get("warc-target-uri"), refers, fields.get("page-id"), fields.get("refers-to-page-id"), digest)
    number = _number(fields.get("warc-segment-number"))
    if number is not None:
        origin = fields.get("warc-segment-origin-id", "").strip("<>") or own
        return origin, *known, None, block, None, number, _number(fields.get("warc-segment-total-length"))
    if kind == "revisit":
        size = _number(http_parts(block)[0].get("content-length")) if block is not None else None
        return own, *known, size, None, block is not None, None, None
    payload = payload_of(block, digest)
    return own, *known, None if payload is None else len(payload), payload, payload is not None, None, None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """RECORD's columns up to intact for every response and revisit under ``path``, segments put together."""
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int64()]

    def rows_of(records: Iterator[tuple[dict[str, str], bytes | None]]) -> Iterator[pa.RecordBatch]:
        wanted = (_described(*r) for r in records if r[0].get("warc-type") in ("response", "revisit", "continuation"))
        while rows := list(itertools.islice(wanted, 200)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=RECORD.names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_of(unpacked(x.as_py() for batch in batches for x in batch.column(0)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((f.as_py(), x.as_py()) for batch in batches for f, x in zip(batch.column(1), batch.column(0), strict=True))
        for _, group in itertools.groupby(lines, lambda line: line[0]):
            yield from rows_of(parse(x for _, x in group))

    value = F.col("value").cast("binary").alias("value")
    ours = spark.read.options(**_ARCHIVES).option("pathGlobFilter", "*.txt").text(path).select(value).mapInArrow(own, RECORD)
    place = F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start").alias("place")
    streamed = spark.read.option("lineSep", MARK.decode()).option("pathGlobFilter", "*.{gz,warc}").text(path).select(value, place).mapInArrow(others, RECORD)
    records = ours.unionByName(streamed)

    names = RECORD.names[:-2]
    joined = row_udf(lambda: reassembled, T.BinaryType(), 2)
    heads = [F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("record_type", "url", "refers_to_id", "page", "refers_to_page", "payload_digest")]
    parts = records.where("number is not null").groupBy("record_id").agg(*heads, F.collect_list(F.struct("number", "total", F.col("payload").alias("block"))).alias("segments"))
    parts = parts.withColumn("payload", joined(F.col("segments"), F.col("payload_digest"))).withColumn("record_type", F.coalesce("record_type", F.lit("response")))
    parts = parts.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("intact", F.col("payload").isNotNull())
    return records.where("number is null").select(names).unionByName(parts.select(names))


def page_of(stated: Column, kind: T.DataType) -> Column:
    """The page's id from a field of read_records."""
    return stated.cast(kind)
