"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, a bundle ends in a seek table (the public seekable format: a skippable frame of frame sizes and a footer), and an index maps every record's identifier to its frame and its offset inside that frame. Bundles are rows of a Parquet dataset (bundle, content, index), written and read by Spark, so any store that Spark reaches will do; `export` writes the same bytes as files.

Records with equal payloads: the one with the largest page_id is the response, the others are revisits that name it. Defined results: null payloads count as empty; records with a null page_id are written and never chosen as a response over one with an id; repeated rows of the chosen page_id are all responses; records take their identifier from the page_id, so rows that repeat one, or have none, repeat the identifier too and the index lists each of them; an empty table makes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import arrow, column, map_batches, spill, texts

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values: magic numbers of the seekable Zstandard format
FRAME_RECORDS, BUNDLE_RECORDS, BUNDLE_BYTES = 16, 1024, 16 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record. A revisit has no payload; its headers hold the full payload's length and digest."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame of (compressed, plain) sizes, with its footer."""
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def frames(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    table, out, at = content[-9 - n * each : -9], [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * each)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(content: bytes, frame: int) -> bytes:
    """Decompress one frame without touching the others."""
    import zstandard

    at, packed, plain = frames(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record that starts at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    return head, data[stop + 4 : end], end + 4


def bundle(records: list[tuple[str, bytes]]) -> tuple[bytes, list[tuple[str, int, int, int]]]:
    """Content, and (record id, frame, offset in the frame, length) of each record."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
    out, sizes, index = [], [], []
    for lo in range(0, len(records), FRAME_RECORDS):
        plain, at = records[lo : lo + FRAME_RECORDS], 0
        for name, data in plain:
            index.append((name, lo // FRAME_RECORDS, at, len(data)))
            at += len(data)
        out.append(packer.compress(b"".join(d for _, d in plain)))
        sizes.append((len(out[-1]), at))
    return b"".join([*out, seek_table(sizes)]), index


def with_digests(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    def run(b):
        return {"page_id": column(b, id_col), "url": column(b, url_col), "html": (t := texts(b, payload_col)), "payload_digest": [digest(x.encode()) for x in t]}

    return map_batches(pages.select(id_col, url_col, payload_col), run, "page_id long, url string, html string, payload_digest string")


def write(pages: DataFrame, path: str, least: int = 0, **cols: str) -> None:
    """Write the bundles to the dataset `path`. Payloads of under `least` bytes are never revisits.

    Digests are counted with a partial aggregate; only those of more than one page are joined back.
    """
    from uuid import uuid4

    rows = with_digests(pages, **cols)
    groups = rows.groupBy("payload_digest").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n"), F.max(F.octet_length("html")).alias("size"))
    groups = spill(groups.filter((F.col("n") > 1) & (F.col("size") >= least)).select("payload_digest", "chosen"), "digests")
    rows = rows.join(groups, "payload_digest", "left").withColumn("refers_to", F.expr("CASE WHEN chosen IS NOT NULL AND (page_id IS NULL OR page_id <> chosen) THEN chosen END"))

    def run(batches):
        held, size = [], 0

        def out():
            content, index = bundle(held)
            at = {n: pa.array([x[i] for x in index], t) for i, (n, t) in enumerate((("record_id", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())))}
            entry = pa.ListArray.from_arrays(pa.array([0, len(index)], pa.int32()), pa.StructArray.from_arrays(list(at.values()), list(at)))
            return pa.RecordBatch.from_arrays([pa.array([uuid4().hex]), pa.array([content], pa.binary()), entry], names=["bundle", "content", "index"])

        for b in batches:
            ids, urls, htmls, sums, refers = (column(b, n).to_pylist() for n in ("page_id", "url", "html", "payload_digest", "refers_to"))
            for i, u, h, d, r in zip(ids, urls, htmls, sums, refers, strict=True):
                data = record(i, u, (h or "").encode(), d, r)
                held.append((f"urn:page:{'' if i is None else i}", data))
                size += len(data)
                if len(held) >= BUNDLE_RECORDS or size >= BUNDLE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = rows.select("page_id", "url", "html", "payload_digest", "refers_to")
    arrow(rows, run, "bundle string, content binary, index array<struct<record_id:string,frame:long,offset:long,length:long>>").write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Every record of the bundles at `path`, frame by frame, as headers and the body; a response's digest is checked against its body."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body string"

    def number(x: str | None) -> int | None:
        return int(x[10:-1]) if x and x != "<urn:page:>" else None

    def run(batches):
        for b in batches:
            for content in column(b, "content"):
                content = content.as_py()
                for k in range(len(frames(content))):
                    data, at, rows = read_frame(content, k), 0, []
                    while at < len(data):
                        head, body, at = parse(data, at)
                        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"][5:]
                        if kind == "response" and (digest(body) != said or len(body) != int(head["X-Payload-Length"])):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(head["X-Payload-Length"]), said, kind, number(head.get("WARC-Refers-To")), body.decode() if kind == "response" else None))
                    cols = list(map(list, zip(*rows, strict=True)))
                    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"])

    return arrow(spark.read.schema("bundle string, content binary").parquet(path).select("content"), run, schema)


def index(spark, path: str) -> DataFrame:
    """(record_id, bundle, frame, offset, length) of every record."""
    df = spark.read.schema("bundle string, index array<struct<record_id:string,frame:long,offset:long,length:long>>").parquet(path)
    return df.select("bundle", F.explode("index").alias("x")).select("x.record_id", "bundle", "x.frame", "x.offset", "x.length")


def export(spark, path: str, folder: str) -> None:
    """Write every bundle as <folder>/<bundle>.warc.zst, in a folder that all executors share."""

    def run(rows):
        for r in rows:
            with open(f"{folder}/{r.bundle}.warc.zst", "wb") as f:
                f.write(r.content)

    spark.read.parquet(path).select("bundle", "content").foreachPartition(run)
