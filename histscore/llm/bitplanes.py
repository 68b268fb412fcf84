"""Token-id files in shuffled planes.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids. A
block is transposed into byte planes (or bit planes), each compressed with
zstandard; a plane of zeros takes no bytes. The footer has the chunk index
(place, ids and plane sizes of every block) and the documents' ids and
lengths, so any block can be read alone.

    magic | block planes ... | footer (zstandard) | footer length, magic

Documents are range-partitioned by id and text hash, so an id that many rows
share is cut like any other range; each task streams its range into files of
about ``FILE_IDS`` ids in the shared folder under names of its own attempt,
and a committed manifest lists the files of the tasks that succeeded. Files of
lost attempts are not in it and never read.

Defined cases: null and empty texts have only the end id; null ids come
first, equal ids in the order of their text's hash; an empty table writes no
file and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histscore.llm.common import open_store, out_dir, slices, whole_texts
from histscore.llm.tokens import encoder, tokenizer_path

MAGIC = b"HPLANES1"
BLOCK, END, LEVEL = 1 << 16, 1, 3
#: Ids, and documents, after which a task begins another file.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 18


def shuffle_block(ids: np.ndarray, planes: str) -> list[bytes]:
    """The block's planes, lowest first; an all-zero plane is empty."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        rows = np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(cells.T)
    return [r.tobytes() if r.any() else b"" for r in rows]


def unshuffle_block(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "bit":
        width = (n + 7) // 8
        rows = np.stack([np.frombuffer(p or bytes(width), np.uint8) for p in parts])
        cells = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    else:
        cells = np.stack([np.frombuffer(p or bytes(n), np.uint8) for p in parts], axis=1)
    return np.ascontiguousarray(cells).view("<u4").reshape(-1)


class PlaneWriter:
    def __init__(self, sink, planes: str = "byte", block: int = BLOCK):
        self.sink, self.planes, self.block = sink, planes, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.index, self.docs, self.sizes = [], [], []
        self.held, self.n, self.at, self.total = [], 0, len(MAGIC), 0
        sink.write(MAGIC)

    def add(self, doc, ids: bytes) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n += len(ids) // 4
        self.total += len(ids) // 4
        if self.n >= self.block:
            flat = np.frombuffer(b"".join(self.held), dtype="<u4")
            whole = len(flat) // self.block * self.block
            for lo in range(0, whole, self.block):
                self._write(flat[lo : lo + self.block])
            self.held, self.n = [flat[whole:].tobytes()], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        parts = [self.pack(p) if p else b"" for p in shuffle_block(ids, self.planes)]
        self.index.append([self.at, len(ids), *map(len, parts)])
        for p in parts:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n:
            self._write(np.frombuffer(b"".join(self.held), dtype="<u4"))
        sizes = np.array(self.sizes, dtype="<i8").tobytes()
        ids = np.array([0 if d is None else d for d in self.docs], dtype="<i8").tobytes()
        head = json.dumps({"planes": self.planes, "index": self.index, "docs": len(self.docs), "nulls": [k for k, d in enumerate(self.docs) if d is None]}).encode()
        foot = self.pack(struct.pack("<Q", len(head)) + head + ids + sizes)
        self.sink.write(foot + struct.pack("<Q", len(foot)) + MAGIC)


class PlaneReader:
    """Random access by block; ``documents`` streams the file in order."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file")
        (n,) = struct.unpack("<Q", tail[:8])
        source.seek(size - 16 - n)
        self.unpack = zstandard.ZstdDecompressor().decompress
        foot = self.unpack(source.read(n))
        (h,) = struct.unpack("<Q", foot[:8])
        head = json.loads(foot[8 : 8 + h])
        self.planes, self.index, docs = head["planes"], head["index"], head["docs"]
        self.sizes = np.frombuffer(foot, "<i8", docs, 8 + h + 8 * docs)
        self.docs = np.frombuffer(foot, "<i8", docs, 8 + h).astype(object)
        self.docs[head["nulls"]] = None

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self.index[k]
        self.source.seek(at)
        raw = self.source.read(sum(lengths))
        parts, lo = [], 0
        for m in lengths:
            parts.append(self.unpack(raw[lo : lo + m]) if m else b"")
            lo += m
        return unshuffle_block(parts, n, self.planes)

    def documents(self):
        """(doc id, start in the file, ids as an iterator of pieces)."""
        k, block, at, start = 0, np.zeros(0, "<u4"), 0, 0
        for doc, size in zip(self.docs, self.sizes.tolist()):
            parts, need = [], size
            while need:
                if at == len(block):
                    block, at, k = self.block(k), 0, k + 1
                take = min(need, len(block) - at)
                parts.append(block[at : at + take])
                at += take
                need -= take
            yield doc, start, size, parts
            start += size


MANIFEST = "part long, file long, path string, docs long, tokens long, size long"


def write_token_files(
    docs: DataFrame,
    path: str | None = None,
    cut: str = "words",
    end_id: int = END,
    planes: str = "byte",
    folder: str | None = None,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes the files and returns the manifest, one row per file."""
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    folder = folder or out_dir(spark, "token-planes")
    end = np.array([end_id], dtype="<u4").tobytes()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = whole_texts(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part, file, writer = TaskContext.get().partitionId(), 0, None
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        ids_of = encoder(path, cut).encode

        def closed():
            writer.close()
            writer.sink.close()
            size = store.get_file_info(f"{base}/{name}").size
            row = {"part": part, "file": file, "path": f"{folder}/{name}", "docs": len(writer.docs), "tokens": sum(writer.sizes), "size": size}
            return pa.RecordBatch.from_pylist([row])

        for _, (ids, texts) in slices(batches, "doc_id", "text"):
            for doc, got in zip(ids, ids_of(texts)):
                if writer is None:
                    name = f"part-{part:06d}-{file:04d}-{uuid.uuid4().hex[:12]}.hpl"
                    writer = PlaneWriter(store.open_output_stream(f"{base}/{name}", compression=None), planes)
                writer.add(doc, got + end)
                if writer.total >= file_ids or len(writer.docs) >= FILE_DOCS:
                    yield closed()
                    writer, file = None, file + 1
        if writer is not None:
            yield closed()

    laid.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    all decoded from the files."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", before)  # one row per file
    files = placed.repartition(max(1, manifest.count()))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, base = open_store(row["path"])
                with store.open_input_file(base) as source:
                    rows = []
                    for doc, start, size, parts in PlaneReader(source, row["size"]).documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(p, crc)
                        rows.append((doc, row["before"] + start, size, crc))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
