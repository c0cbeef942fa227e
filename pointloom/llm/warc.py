"""WARC archives compressed with Zstandard, one frame per record, with a shared dictionary in a leading skippable frame.

Writing finds equal payloads first: of each group the record of the largest page_id carries the payload, the others
become revisit records that refer to it. Only digests and ids are grouped; pages are not moved by it unless the table
of repeated payloads outgrows a broadcast. Reading decodes frame by frame and validates every header and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, share_hash, slices
from pointloom.sources.recordings import file_system

DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:page:{}>"
END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block keeps the HTTP header (and so the payload's length) only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {RECORD.format('' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD.format(refers_to)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse_record(data: bytes) -> dict:
    """The fields of one record; ValueError where a header is missing or malformed, or a length or digest is wrong."""
    head, found, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("a record does not begin with a WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"malformed or repeated header: {line[:80]}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    length = int(fields["content-length"])
    if length < 0 or len(rest) != length + len(END) or not rest.endswith(END):
        raise ValueError(f"the block has {len(rest) - len(END)} bytes, its header says {length}")
    kind, block = fields["warc-type"], rest[:length]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind}")
    http, found, payload = block.partition(END)
    told = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or len(told) != 1 or not http.startswith(b"HTTP/"):
        raise ValueError("the block has no proper HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != told[0] or base32_sha1(payload) != digest):
        raise ValueError("the payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields or len(digest) != 32):
        raise ValueError("a revisit record needs a digest, a reference and no payload")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": told[0],
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def read_frames(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The content of each frame after the dictionary; ValueError where a frame is cut short."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if raw[:4] == ZSTD_MAGIC:  # it may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        at, dictionary = 8 + size, zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            piece = data[at : at + step]
            if not piece:
                raise ValueError("a frame is cut short")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


#: What records have in common at the least: the dictionary where there are too few pages to train one.
PLAIN_DICTIONARY = record_bytes(0, "http://www.example.com/index.html", b"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title></title></head><body><div><p><a href=\"</a></p></div></body></html>", None)


def train_dictionary(pages: DataFrame, *, rows: int = 200, size: int = 32 << 10, most_bytes: int = 4 << 20) -> bytes:
    """A dictionary from the ``rows`` whole pages of least hash among those of moderate length (``most_bytes`` in all).

    Where there are under 20 the dictionary is plain content: a record of no page in particular. The same pages give the same dictionary.
    """
    per_page = most_bytes // rows
    draw = share_hash(F.lit("dictionary"), "page_id", F.octet_length("html"))
    fit = pages.where(F.octet_length("html").between(8, per_page) & (draw < 4.0 * rows / max(1, pages.count())))
    samples = sorted(r.html.encode() for r in fit.orderBy(draw, "page_id", F.xxhash64("html")).limit(rows).select("html").collect())
    if len(samples) < 20:
        return PLAIN_DICTIONARY
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # they have too little content
        return PLAIN_DICTIONARY


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, roll_bytes: int = 8 << 20, level: int = 3, dictionary: bytes | None = None) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the manifest (file, records, bytes).

    Payloads are the html in UTF-8, null being empty. Of rows with equal payloads of at least ``min_bytes`` bytes those of
    the largest page_id are responses, the others revisit it; a null page_id counts as smaller than all, and a group
    of nothing but null ids is all responses, as are all smaller payloads. Repeated rows get a record each; columns other than these
    three are ignored; an empty table makes no file. Every file begins with the dictionary, in a skippable frame. Files are rolled near ``roll_bytes``, so a reader holds little at a time. A task writes
    files under names of its attempt; those of the attempts that count are in the manifest, which is also written into the folder and which
    readers go by. What an attempt that was lost has left there, or an earlier writing, is not read any more.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    dictionary = train_dictionary(pages) if dictionary is None else dictionary
    pages = pages.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha1("html")))
    repeated = pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialise(repeated, "repeated-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = pages.join(repeated, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    leading = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
    shared = spark.sparkContext.broadcast(leading)  # a few dozen kB

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, files = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", []
        lead = shared.value
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(lead[8:]))
        out, size, records = None, 0, 0
        for batch in slices(batches, "html"):
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None:
                    if not files:
                        fs.create_dir(root, recursive=True)
                    files.append([f"{name}-{len(files):04d}.warc.zst", 0, 0])
                    out, size, records = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None), len(lead), 0
                    out.write(lead)
                frame = packer.compress(record_bytes(row[0], row[1], row[2].encode(), row[3]))
                out.write(frame)
                size, records = size + len(frame), records + 1
                files[-1][1:] = records, size
                if size >= roll_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([f[0] for f in files], pa.string()), "records": pa.array([f[1] for f in files], pa.int64()), "bytes": pa.array([f[2] for f in files], pa.int64())})

    rows.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/{MANIFEST_FOLDER}")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/{MANIFEST_FOLDER}")


MANIFEST, MANIFEST_FOLDER = "file string, records bigint, bytes bigint", "_manifest"
FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    """A row for every record of the archives in ``folder``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for.

    A revisit's payload is null. Archives with a malformed record fail the job with its reason. Of a folder that ``write_archives`` wrote the
    archives of its manifest are read, of another one all whose names end in .warc.zst, each of up to 2 GiB.
    """
    fields = FIELDS.append(pa.field("payload", pa.binary())) if payloads else FIELDS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", 1):
            rows, size = [], 0
            for frame in read_frames(batch.column("content")[0].as_py()):
                row = parse_record(frame)
                if not payloads:
                    del row["payload"]
                rows.append(row)
                size += len(frame) if payloads else 200
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=fields)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST_FOLDER}")
    if manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        attempt = lambda name: F.regexp_extract(name, r"([^/]+)-[0-9]+\.warc\.zst$", 1)
        named = spark.read.schema(MANIFEST).parquet(f"{folder}/{MANIFEST_FOLDER}").select(attempt("file").alias("_attempt")).distinct()
        archives = archives.join(F.broadcast(named), attempt("path") == F.col("_attempt"), "left_semi")  # a row for each task that wrote
    return archives.select("content").mapInArrow(read, schema)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][('0x' || substr(hex, i::INT, 1))::INT + 1]), '') AS bits FROM d),
g AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, (5 * j + 1)::INT, 1)::INT + 8 * substr(bits, (5 * j + 2)::INT, 1)::INT
          + 4 * substr(bits, (5 * j + 3)::INT, 1)::INT + 2 * substr(bits, (5 * j + 4)::INT, 1)::INT + substr(bits, (5 * j + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
      max(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
