"""Token-id files: one wavelet matrix for each shard of documents.

A shard's ids are stored as bit-planes, from the most significant bit on; each plane holds one bit of every id in the
order that a stable partition by the planes above it leaves. Beside each plane stands its directory, the number of ones in
each block of ``BLOCK`` bits: with their running sums a plane answers rank from one block's bits, and select by a search of
the directory and one block's bits. The file gives the id at a place, the number of times an id occurs before a place, and
the places where it occurs, without holding the ids themselves. Planes and directories are compressed one by one.

File: ``MAGIC``, length of the header, JSON header (n, bits, zeros of each plane, documents, documents without id, sizes of
the parts), then the parts, each a zstandard frame: document ids, the offsets of the documents' ids, the planes, the
directories. The offsets are left out where each document's end id tells them: they are then the places of that id.

Edge cases: a null text has only its end id; a null ``doc_id`` sorts first and stays null; repeated rows are written
each; an empty table gives no file rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import materialise, scratch, small_batches, table
from plumbline.llm.tokens import default_path, encoder

MAGIC = b"WVM2"
END_ID = 2
#: Text bytes of a shard.
SHARD_BYTES = 16 << 20
BLOCK = 512
#: Shards whose running starts a task adds up.
SHARD_GROUP = 1024
Batches = Iterator[pa.RecordBatch]


def directory_of(plane: np.ndarray) -> np.ndarray:
    """Ones in each block of a plane."""
    padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(plane)] = plane
    return np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint16)


class WaveletMatrix:
    """Bit-planes with rank and select over ``n`` ids of ``bits`` bits."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], directories: list[np.ndarray] | None = None):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes
        self.directories = [directory_of(p) for p in planes] if directories is None else directories
        self._ones = [np.concatenate([[0], np.cumsum(d, dtype=np.int64)]) for d in self.directories]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for level in range(bits):
            bit = (now & now.dtype.type(1 << (bits - 1 - level))) != 0
            low, high = now[~bit], now[bit]
            planes.append(np.packbits(bit))
            zeros.append(len(low))
            now = np.concatenate([low, high])
        return cls(len(ids), bits, zeros, planes)

    def ids(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane to the first."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before = np.empty_like(now)
            before[~bit] = now[: self.zeros[level]]
            before[bit] = now[self.zeros[level] :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = before
        return now.astype(np.uint32)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of the plane before each place."""
        plane = self.planes[level]
        at = np.asarray(at, np.int64)
        block, out = at // BLOCK, self._ones[level][at // BLOCK].copy()
        for k in range(BLOCK // 8):  # the whole bytes between the block's start and the place
            byte = block * (BLOCK // 8) + k
            use = byte < at // 8
            out[use] += np.bitwise_count(plane[byte[use]])
        rest = at % 8
        part = rest > 0
        out[part] += np.bitwise_count(plane[at[part] // 8] >> (8 - rest[part]).astype(np.uint8))
        return out

    def _select(self, level: int, bit: int, number: np.ndarray) -> np.ndarray:
        """The places of the ones, or zeros, with these numbers, from 0; numbers ascend."""
        ones = self._ones[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        out = np.empty(len(number), np.int64)
        for lo in range(0, len(number), 4096):  # so many blocks' bits at a time
            some = number[lo : lo + 4096]
            block = np.searchsorted(before, some, "right") - 1
            which, row = np.unique(block, return_inverse=True)
            size = BLOCK // 8
            padded = np.zeros((len(which), size), np.uint8)
            for k, b in enumerate(which.tolist()):
                part = self.planes[level][b * size : (b + 1) * size]
                padded[k, : len(part)] = part
            bits = np.unpackbits(padded, axis=1) == bit
            at = np.flatnonzero(bits)
            first = np.cumsum(bits.sum(1)) - bits.sum(1)
            out[lo : lo + 4096] = block * BLOCK + at[first[row] + some - before[block]] % BLOCK
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the places ``at``."""
        at = np.asarray(at, np.int64).copy()
        out = np.zeros(len(at), np.uint32)
        for level in range(self.bits):
            bit = (self.planes[level][at // 8] >> (7 - at % 8).astype(np.uint8)) & 1
            ones = self._rank1(level, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def rank(self, token: int, at: int) -> int:
        """How often ``token`` occurs before place ``at``."""
        lo, hi = self._range(token, at)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _range(self, token: int, at: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        lo, hi = 0, at
        for level in range(self.bits):
            ones = self._rank1(level, np.array([lo, hi]))
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = (self.zeros[level] + ones).tolist()
            else:
                lo, hi = lo - int(ones[0]), hi - int(ones[1])
        return lo, hi

    def occurrences(self, token: int) -> np.ndarray:
        """The places of ``token``, ascending: its range below the last plane, selected back upwards."""
        lo, hi = self._range(token, self.n)
        at = np.arange(lo, hi)
        for level in reversed(range(self.bits) if len(at) else range(0)):
            if token >> (self.bits - 1 - level) & 1:
                at = self._select(level, 1, at - self.zeros[level])
            else:
                at = self._select(level, 0, at)
        return at


def to_bytes(ids: np.ndarray, doc_ids: np.ndarray, nulls: int, offsets: np.ndarray) -> bytes:
    """A file's bytes; the first ``nulls`` documents have no id."""
    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    told = matrix.count(END_ID) == len(doc_ids) and bool((ids[offsets[1:] - 1] == END_ID).all())
    kept = np.zeros(0, np.int64) if told else offsets
    parts = [doc_ids.astype("<i8"), kept.astype("<i8"), *matrix.planes, *[d.astype("<u2") for d in matrix.directories]]
    parts = [pack(p.tobytes()) for p in parts]
    header = {"n": matrix.n, "bits": matrix.bits, "zeros": matrix.zeros, "docs": len(doc_ids), "nulls": nulls, "told": told, "sizes": [len(p) for p in parts]}
    text = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *parts])


def from_bytes(raw: bytes) -> tuple[WaveletMatrix, pa.Array, np.ndarray]:
    """(matrix, document ids, offsets of each document's ids) of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    end = 8 + struct.unpack("<I", raw[4:8])[0]
    header = json.loads(raw[8:end])
    parts = []
    for size in header["sizes"]:
        parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[end : end + size]), np.uint8))
        end += size
    bits = header["bits"]
    matrix = WaveletMatrix(header["n"], bits, header["zeros"], parts[2 : 2 + bits], [p.view("<u2") for p in parts[2 + bits :]])
    offsets = np.concatenate([[0], matrix.occurrences(END_ID) + 1]) if header["told"] else parts[1].view("<i8")
    return matrix, pa.array(parts[0].view("<i8"), mask=np.arange(header["docs"]) < header["nulls"]), offsets


def write_shards(folder: str, path: str) -> Callable[[Batches], Batches]:
    """Writes a task's documents, which come in order, to one file; gives (shard, path, n_docs, n_tokens)."""

    def run(batches: Batches) -> Batches:
        from pyarrow import fs

        words, ids, doc_ids, lengths, nulls = encoder(path), [], [], [], 0
        for batch in arrays.pieces(batches):
            got, of = words.encode(*arrays.buffer(batch.column("text")))
            ended = np.insert(got.astype(np.uint16) if words.ends_word.size <= 1 << 16 else got, of[1:], END_ID)
            ids.append(ended)
            lengths.append(np.diff(of) + 1)
            nulls += batch.column("doc_id").null_count
            doc_ids.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
        if not ids:
            return
        task = TaskContext.get()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        raw = to_bytes(np.concatenate(ids), np.concatenate(doc_ids), nulls, offsets)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"shard-{task.partitionId():06d}.wvm"
        # Another attempt at this task writes the same bytes; the rename makes a file appear whole.
        with store.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}") as out:
            out.write(raw)
        store.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [name], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    return run


def read_shards(batches: Batches) -> Batches:
    """(name, k, doc_id, at, n_tokens, ids_crc32) of every document in the files."""
    for batch in batches:
        for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            matrix, doc_ids, offsets = from_bytes(raw.as_buffer().to_pybytes())
            ids = matrix.ids().astype("<u4")
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name.rpartition("/")[2]] * len(crc)),
                    pa.array(np.arange(len(crc))),
                    doc_ids,
                    pa.array(offsets[:-1].astype(np.int64)),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(np.array(crc, np.int64)),
                ],
                ["name", "k", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def write(docs: DataFrame, folder: str, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``docs`` (doc_id, text) in ascending order of doc_id; gives (shard, path, n_docs, n_tokens) of every file."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = docs.withColumn("tie", tie).repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    written = dealt.select("doc_id", "text").mapInArrow(write_shards(folder, path or default_path()), "shard long, path string, n_docs long, n_tokens long")
    return materialise(written, "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names. The running start
    of the files is added up over groups of the manifest's rows, one short row for each file, and then within a group."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("path", "content")
    docs = files.mapInArrow(read_shards, "name string, k long, doc_id long, at long, n_tokens long, ids_crc32 long")
    upto = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.select("shard", F.col("path").alias("name"), "n_tokens", F.floor(F.col("shard") / SHARD_GROUP).alias("group"))
    groups = rows.groupBy("group").agg(F.sum("n_tokens").alias("n_tokens"))
    groups = groups.select("group", upto(Window.orderBy("group")).alias("before"))
    base = rows.join(groups, "group").select("name", (F.col("before") + upto(Window.partitionBy("group").orderBy("shard"))).alias("base"))
    return docs.join(base, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    manifest = write(table(spark, sf_dir, "documents"), folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest)
