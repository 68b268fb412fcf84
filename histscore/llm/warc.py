"""Seekable Zstandard WARC bundles.

Records are grouped into frames that decompress alone. After the frames
come two skippable frames: a map from record id to (frame, offset in the
frame, length), and the seek table of the Zstandard seekable format, so any
zstd tool reads the bundle as one stream and a reader with the map fetches a
record by decompressing one frame.

Deduplication: of records with equal payloads (SHA-1 and length) of at least
``MIN_BYTES``, the one with the largest page_id is a response and the others
are revisits of it; smaller payloads are all responses.

A task writes its rows as bundles of at most ``BUNDLE`` bytes under names of
its own attempt; the committed manifest lists those of successful tasks.

Defined cases: null html is an empty payload; a null url becomes
``urn:page:<id>``; rows with equal page_id and payload are one page and get
the same type; a null page_id is never a response's name: such a row revisits
the group's largest id, or is a response if the group has none; an empty
table writes nothing and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histscore.llm.common import open_store, out_dir, slices

MIN_BYTES = 1000
#: Uncompressed bytes of a frame, compressed bytes of a bundle.
FRAME, BUNDLE, LEVEL = 1 << 20, 256 << 20, 3
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (the
    response's page_id for a revisit, else null). Groups are reduced to one
    row per task before the shuffle; only groups of two or more are joined."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"),
    )
    groups = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("g_digest"), F.col("payload_bytes").alias("g_bytes"))
        .agg(F.max("page_id").alias("g_page"), F.count("*").alias("g_rows"))
        .filter("g_rows > 1 and g_page is not null")
    )
    on = (F.col("payload_digest") == F.col("g_digest")) & (F.col("payload_bytes") == F.col("g_bytes"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("g_page")), F.col("g_page"))
    return rows.join(groups, on, "left").withColumn("refers_to", refers).drop("g_digest", "g_bytes", "g_page", "g_rows")


def record_id(page_id, at: str = "") -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{at}')}"


def record_bytes(name: str, page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has the response's HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = "".join(c for c in (url or f"urn:page:{page_id}") if c not in "\r\n")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("X-Refers-To-Page", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length"))
    return fields, payload


class BundleWriter:
    def __init__(self, sink):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames, self.map = [], []
        self.held, self.size, self.written = [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        self.map.append((name, len(self.frames), self.size, len(record)))
        self.held.append(record)
        self.size += len(record)
        if self.size >= FRAME:
            self._frame()

    def _frame(self) -> None:
        packed = self.pack(b"".join(self.held))
        self.sink.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        table = self.pack(json.dumps(self.map).encode())
        table += struct.pack("<Q", len(table))
        seek = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        for magic, body in ((SKIPPABLE_MAP, table), (SKIPPABLE_SEEK, seek)):
            self.sink.write(struct.pack("<II", magic, len(body)) + body)


class BundleReader:
    def __init__(self, source, size: int):
        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        at = size - 9 - 8 * n
        source.seek(at)
        table = source.read(8 * n)
        self.frames, place = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((place, packed, plain))
            place += packed
        source.seek(at - 16)  # before the seek frame's own head
        (m,) = struct.unpack("<Q", source.read(8))
        source.seek(at - 16 - m)
        self.map = [tuple(x) for x in json.loads(self.unpack(source.read(m)))]
        self.by_name = None

    def frame(self, k: int) -> bytes:
        place, packed, plain = self.frames[k]
        self.source.seek(place)
        return self.unpack(self.source.read(packed))

    def record(self, name: str) -> bytes:
        """One record by its id, through the map and one frame."""
        if self.by_name is None:
            self.by_name = {x[0]: x[1:] for x in self.map}
        frame, offset, n = self.by_name[name]
        return self.frame(frame)[offset : offset + n]

    def records(self):
        """(id, record) in file order, one frame in memory at a time."""
        held, data = None, b""
        for name, frame, offset, n in self.map:
            if frame != held:
                held, data = frame, self.frame(frame)
            yield name, data[offset : offset + n]


MANIFEST = "path string, records long, size long"


def write_bundles(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes rows of ``decide_records``; returns the manifest."""
    spark = records.sparkSession
    folder = folder or out_dir(spark, "warc")
    cols = ["page_id", "url", "html", "payload_digest", "refers_to"]

    def run(batches):
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        store = writer = sink = None
        count = seen = 0

        def finish():
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(writer.map), "size": store.get_file_info(f"{base}/{name}").size}])

        for _, columns in slices(batches, *cols):
            for page_id, url, html, digest, refers_to in zip(*columns):
                if writer is None:
                    store, base = open_store(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{attempt}-{count}.warc.zst"
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer, count = BundleWriter(sink), count + 1
                # the response of a page has the page's own id, so revisits can name it
                seen += 1
                own = record_id(page_id, "" if refers_to is None and page_id is not None else f"{attempt}:{part}:{seen}")
                writer.add(own, record_bytes(own, page_id, url, html.encode(), digest, refers_to))
                if writer.written >= BUNDLE:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    records.select(*cols).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """One row per record, from the files: page_id, payload_bytes,
    payload_digest (checked against the payload of a response), record_type,
    refers_to."""
    files = manifest.repartition(max(1, manifest.count()))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, base = open_store(row["path"])
                with store.open_input_file(base) as source:
                    out = []
                    for _, raw in BundleReader(source, row["size"]).records():
                        fields, payload = parse_record(raw)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        kind = fields["WARC-Type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged payload in {row['path']}")
                        number = lambda x: int(x) if x else None
                        out.append((number(fields["X-Page-ID"]), int(fields["http-length"]), digest, kind, number(fields.get("X-Refers-To-Page"))))
                        if len(out) == 5000:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

    return files.mapInArrow(run, schema)


def _batch(rows) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
