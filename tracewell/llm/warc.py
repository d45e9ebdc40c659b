"""WARC archives: one record per page, revisits for equal payloads, and reassembly of segmented records.

Writing: each task writes one gzip member per record to its own archive in the shared folder, under a temporary name that is
then renamed. A block longer than ``segment_bytes`` is split: the first record has segment number 1, continuation records name
it as their origin, the last one states the total length. Bodies are framed as chunks.

Reading: archives are parsed in parallel. Segments are grouped by origin identifier, ordered by number, and their total length
is verified; then the chunked framing is decoded and the payload's digest compared with the header.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = b"\r\n"
DATE = b"2020-01-01T00:00:00Z"  # fixed, so that a retried task writes the same bytes


def revisit_targets(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat another's payload of ``least_bytes`` or more."""
    slim = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes).select("page_id", "digest")
    largest = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return slim.join(largest, "digest").where("page_id <> refers_to or page_id is null").select("page_id", "digest", "refers_to").distinct()


def chunked(body: bytes, size: int = 1 << 16) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(body[k : k + size]), body[k : k + size]) for k in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    """Undo chunked transfer framing; extensions and trailers are passed over. Broken framing raises ValueError."""
    out, at = [], 0
    while True:
        end = data.find(END, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != END:
            raise ValueError("chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: bytes, **fields) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <%s>" % record_id.encode(), b"WARC-Date: " + DATE]
    head += [f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items() if v is not None]
    return gzip.compress(END.join([*head, b"Content-Length: %d" % len(block), b"", block, b"", b""]), 4, mtime=0)


def page_records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, own: str, segment_bytes: int) -> list[bytes]:
    """The records of one page; ``own`` tells rows with equal ids apart."""
    body = (html or "").encode("utf-8", "surrogatepass")
    record_id = f"urn:page:{own}"
    common = {"WARC_Page_ID": page_id, "WARC_Target_URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~") or None, "WARC_Payload_Digest": f"sha1:{hashlib.sha1(body).hexdigest()}"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields = common | {"WARC_Refers_To_Page_ID": refers_to, "WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [_record("revisit", record_id, http + b"Content-Length: %d\r\n\r\n" % len(body), **fields)]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(body)
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record("response", record_id, block, **common)]
    out = [_record("response", record_id, parts[0], WARC_Segment_Number=1, **common)]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(_record("continuation", f"{record_id}:{k}", part, WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
    return out


def write_warc(pages: DataFrame, out: str, least_bytes: int = 1000, segment_bytes: int = 1 << 15) -> list[str]:
    """Write every page to archives in the folder ``out``; returns their names, one per task that had rows.

    Of pages with equal payloads of ``least_bytes`` or more the one with the largest id is the response, the others revisit it;
    rows with that same id are responses too. A null html is empty, a null id has no page header and revisits like any other.
    An empty table gives no archive. Extra columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    again = revisit_targets(pages, least_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    rows = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        name, mark, sink, k = f"part-{TaskContext.get().partitionId():06d}.warc.gz", uuid.uuid4().hex, None, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sink = sink or fs.open_output_stream(f"{root}/{name}.{mark}", compression=None)
                for record in page_records(page_id, url, html, refers_to, f"{name[5:11]}-{k}", segment_bytes):
                    sink.write(record)
                k += 1
        if sink:
            sink.close()
            fs.move(f"{root}/{name}.{mark}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return sorted(r.name for r in rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "name string").collect())


def parse_records(stream, read: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a gzip archive with one member per record."""
    data, ended = b"", False
    while True:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not data:
                data = stream.read(read)
                if not data:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    ended = True
                    break
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
        if ended:
            return
        raw = b"".join(parts)
        head, _, rest = raw.partition(END + END)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
        yield fields, rest[: int(fields["content-length"])]


_FIELDS = "origin string, segment int, total long, record_type string, page_id long, url string, digest string, refers_to long, block binary"
_PARSED = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])


def _parsed(spark: SparkSession, out: str, names: list[str]) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                rows, held = [], 0
                for h, block in parse_records(f):
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    segment, origin = number("warc-segment-number"), h.get("warc-segment-origin-id", h["warc-record-id"]).strip("<>")
                    url = unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None
                    rows.append((origin, segment, number("warc-segment-total-length"), h["warc-type"], number("warc-page-id"), url, h.get("warc-payload-digest", "").removeprefix("sha1:"), number("warc-refers-to-page-id"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED.types, strict=True)], schema=_PARSED)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED.types, strict=True)], schema=_PARSED)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return files.mapInArrow(parse, _FIELDS)


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the blocks, verify length and digest, and take the payload out of the HTTP message."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            block = b"".join(r["blocks"])
            if r["segments"] is not None and r["segments"] != list(range(1, len(r["segments"]) + 1)):
                raise ValueError(f"{r['origin']}: segments {r['segments']}")
            if r["segments"] is not None and r["total"] != len(block):
                raise ValueError(f"{r['origin']}: {len(block)} bytes of {r['total']}")
            head, _, body = block.partition(END + END)
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
            if r["record_type"] == "revisit":
                payload, n = None, int(fields["content-length"])
            else:
                payload = dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
                n = len(payload)
                if hashlib.sha1(payload).hexdigest() != r["digest"]:
                    raise ValueError(f"{r['origin']}: the digest differs")
            rows.append((r["page_id"], r["url"], n, r["digest"], r["record_type"], r["refers_to"], payload))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_warc(spark: SparkSession, out: str, names: list[str]) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of every record.

    Unsegmented records stay where they are parsed; only segments are shuffled, by origin. A missing segment, a wrong total
    length or digest, and broken framing raise. No archives give no rows.
    """
    records = _parsed(spark, out, names)
    result = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    columns = ["origin", "record_type", "page_id", "url", "digest", "refers_to", "total", "segments", "blocks"]
    single = records.where("segment is null").withColumn("segments", F.lit(None).cast("array<int>")).withColumn("blocks", F.array("block")).select(columns)
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = (
        records.where("segment is not null")
        .groupBy("origin")
        .agg(*[first(c) for c in ("record_type", "page_id", "url", "digest", "refers_to")], F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"))
        .withColumn("segments", F.col("s.segment"))
        .withColumn("blocks", F.col("s.block"))
        .select(columns)
    )
    return single.mapInArrow(_payloads, result).unionByName(joined.mapInArrow(_payloads, result))
