"""Packing by lexical retrieval.

Documents are dealt to shards of bounded size by content: a document's keys are the terms that consistent sampling draws
from it, rare terms with more weight, so that two documents get the same first key as often as their weighted terms
agree. Shards are ranges of these keys, and a key of more documents than a shard holds is split by the keys after it. A
shard builds a BM25 inverted index over the token ids of its pieces, with the inverse document frequencies of the
whole table; each seed, the longest piece that is left, asks it for its unused neighbours, and these fill the seed's window in order
of their scores. A neighbour that doesn't fit whole is passed over while another fits, and the best one left is cut to
close the window, so that only a shard's last sequence is padded. What is left of a cut document goes back to the
pool. Documents longer than a window fill whole windows first.

Edge cases: a null text has only its end id; repeated rows are packed each; a null ``doc_id`` is carried as it is; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import materialise, release, small_batches, table
from plumbline.llm.tokens import default_path, encoder

WINDOW, END_ID = 2048, 1
#: Text bytes of a shard.
SHARD_BYTES = 8 << 20
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Keys of a document, and the power of the inverse document frequency that weighs a term in them.
KEYS, RARE = 3, 2.0
#: Terms in more than this share of a shard's documents have their scores in full rows.
HOT = 0.125
Batches = Iterator[pa.RecordBatch]
PLAIN = "doc_id long, ids binary"
ENCODED = f"{PLAIN}, " + ", ".join(f"key{k} long" for k in range(KEYS))
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def inverse(n: int, df: np.ndarray) -> np.ndarray:
    """BM25's inverse document frequency."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """Inverted BM25 index over documents given as token ids; ``idf`` by token id, or else of these documents."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, idf: np.ndarray | None = None):
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        pair, tf = np.unique(ids.astype(np.int64) << 32 | doc, return_counts=True)
        term, self.doc = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int64)
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        self.first = np.append(np.flatnonzero(new), len(term))
        number = np.cumsum(new) - 1
        df = np.diff(self.first)
        idf = inverse(n, df)[number] if idf is None else idf[term]
        length = np.diff(offsets)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        self.weight = (idf * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        # Scores of terms in many documents as full rows: no more than 1 / HOT times the postings.
        hot = np.flatnonzero(df > max(1, HOT * n))
        self.row = np.full(len(df), -1)
        self.row[hot] = np.arange(len(hot))
        self.rows = np.zeros((len(hot), n), np.float32)
        in_row = self.row[number] >= 0
        self.rows[self.row[number[in_row]], self.doc[in_row]] = self.weight[in_row]
        # The terms of each document that another document shares.
        shared = np.flatnonzero(df[number] > 1)
        order = shared[np.argsort(self.doc[shared], kind="stable")]
        self.query_terms = number[order]
        self.query_at = np.searchsorted(self.doc[order], np.arange(n + 1))

    def neighbours(self, doc: int, n: int) -> np.ndarray:
        """Documents that share a term with ``doc``, by falling score, then by number."""
        terms = self.query_terms[self.query_at[doc] : self.query_at[doc + 1]]
        row = self.row[terms]
        few = terms[row < 0]
        place = arrays.expand(self.first[few], self.first[few + 1] - self.first[few])
        score = np.bincount(self.doc[place], weights=self.weight[place], minlength=n)
        score = score + self.rows[row[row >= 0]].sum(0)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def keys(ids: np.ndarray, offsets: np.ndarray, drawn: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """KEYS numbers for each document, by consistent weighted sampling of its distinct terms; -1 for none. ``drawn``: the
    :func:`draws` of each key."""
    n = len(offsets) - 1
    doc, term = distinct(ids, offsets)
    out = np.full((KEYS, n), -1, np.int64)
    first = np.searchsorted(doc, np.arange(n))
    some = np.flatnonzero(np.diff(np.append(first, len(doc))))
    for k, (mixed, draw) in enumerate(drawn if len(some) else []):
        of = draw[term]
        # The least draw of each document, the first of equal ones.
        least = np.repeat(np.minimum.reduceat(of, first[some]), np.diff(np.append(first[some], len(doc))))
        at = np.flatnonzero(of == least)
        at = at[np.diff(doc[at], prepend=-1) != 0]
        out[k, some] = (mixed[term[at]] >> np.uint64(1)).astype(np.int64)
    return out


def distinct(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) once each, in order."""
    pair = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) << 32 | ids.astype(np.int64)
    pair.sort()
    pair = pair[np.diff(pair, prepend=-1) != 0]
    return pair >> 32, pair & 0xFFFFFFFF


def draws(k: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and draw of each token id for the ``k``-th key."""
    mixed = arrays.mix(np.arange(len(idf), dtype=np.uint64) + np.uint64((k + 1) << 40))
    draw = -np.log(((mixed >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / np.maximum(idf, 1e-6) ** RARE
    return mixed, draw


def pack(ids: np.ndarray, offsets: np.ndarray, window: int = WINDOW, idf: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, first id, number of ids, sequence, offset in it) of every piece."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    start = np.zeros(n, np.int64)
    for doc in np.flatnonzero(length >= window).tolist():
        for _ in range(int(length[doc]) // window):
            out.append((doc, int(start[doc]), window, sequence, 0))
            start[doc] += window
            sequence += 1
    left = length - start
    index = Index(ids, offsets, idf)
    seeds = np.lexsort((np.arange(n), -left)).tolist()
    k = 0
    while k < len(seeds):
        doc = seeds[k]
        if not left[doc]:
            k += 1
            continue
        filled = 0

        def take(d: int) -> None:
            nonlocal filled
            size = min(int(left[d]), window - filled)
            out.append((d, int(start[d]), size, sequence, filled))
            start[d] += size
            left[d] -= size
            filled += size

        take(doc)
        if filled < window:
            near = index.neighbours(doc, n)
            near = near[left[near] > 0]
            for d in near[left[near] <= window - filled].tolist():
                if left[d] and left[d] <= window - filled:
                    take(d)
                if filled == window:
                    break
            for d in near.tolist():
                if filled == window:
                    break
                if left[d]:
                    take(d)
            j = k
            while filled < window and j < len(seeds):  # no neighbour is left: whichever comes next
                if left[seeds[j]]:
                    take(seeds[j])
                j += 1
        sequence += 1
    return out


def encoded(path: str, batches: Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, token ids with an end id after each text, offsets)."""
    words = encoder(path)
    for batch in arrays.pieces(batches):
        got, of = words.encode(*arrays.buffer(batch.column("text")))
        yield batch, np.insert(got, of[1:], END_ID), of + np.arange(len(of))


def encode(path: str) -> Callable[[Batches], Batches]:
    """Token ids of each text."""

    def run(batches: Batches) -> Batches:
        for batch, ids, of in encoded(path, batches):
            flat = pa.py_buffer(ids.astype("<u4"))
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(4 * of.astype(np.int64)), flat])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blob.cast(pa.binary())], ["doc_id", "ids"])

    return run


def read(batches: Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, token ids, offsets) of encoded texts."""
    for batch in arrays.pieces(batches, "ids"):
        data, of = arrays.buffer(batch.column("ids"))
        yield batch, np.frombuffer(data.tobytes(), "<u4"), of // 4


def count_terms(size: int) -> Callable[[Batches], Batches]:
    """(term, number of documents that hold it) of a task's rows; the number of documents as that of term -1."""

    def run(batches: Batches) -> Batches:
        df, n = np.zeros(size, np.int64), 0
        for batch, ids, of in read(batches):
            df += np.bincount(distinct(ids, of)[1], minlength=size)
            n += batch.num_rows
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(df[term], n))], ["term", "n"])

    return run


def keyed(idf: np.ndarray) -> Callable[[Batches], Batches]:
    """Encoded texts with their keys."""

    def run(batches: Batches) -> Batches:
        drawn = [draws(k, idf) for k in range(KEYS)]
        for batch, ids, of in read(batches):
            columns = [batch.column("doc_id"), batch.column("ids"), *map(pa.array, keys(ids, of, drawn))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", *(f"key{k}" for k in range(KEYS))])

    return run


def pack_shards(idf: np.ndarray, window: int, most: int) -> Callable[[Batches], Batches]:
    """Packs a task's documents; a task is a shard, or several of about ``most`` ids where its documents are long."""

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        size, base = 0, np.int64(TaskContext.get().partitionId()) << 32

        def shard() -> pa.RecordBatch:
            nonlocal base
            data = [arrays.buffer(b.column("ids")) for b in held]
            whole = np.concatenate([np.frombuffer(d.tobytes(), "<u4") for d, _ in data])
            offsets = np.cumsum(np.concatenate([[0], *(np.diff(of) // 4 for _, of in data)])).astype(np.int64)
            doc, start, length, sequence, offset = np.array(pack(whole, offsets, window, idf), np.int64).reshape(-1, 5).T
            view = memoryview(whole).cast("B")
            lo = offsets[doc] + start
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            doc_ids = pa.chunked_array([b.column("doc_id") for b in held]).combine_chunks()
            columns = (start, length, np.array(crc, np.int64), np.diff(offsets)[doc], base + sequence, offset)
            base += sequence.max() + 1
            return pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(doc)), *map(pa.array, columns)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in arrays.pieces(batches, "ids"):
            held.append(batch)
            size += len(arrays.buffer(batch.column("ids"))[0]) // 4
            if size >= most:
                yield shard()
                held, size = [], 0
        if held:
            yield shard()

    return run


def frequencies(docs: DataFrame, path: str) -> np.ndarray:
    """Inverse document frequency by token id, over all documents."""
    return counted(docs.select("doc_id", "text").mapInArrow(encode(path), PLAIN), encoder(path).library.get_vocab_size())


def counted(ids: DataFrame, size: int) -> np.ndarray:
    """The same from encoded documents."""
    every = ids.select("ids").mapInArrow(count_terms(size), "term long, n long")
    got = {r.term: r.n for r in every.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # bounded by the vocabulary
    df = np.zeros(size, np.int64)
    n = got.pop(-1, 0)
    df[list(got)] = list(got.values())
    return inverse(n, df)


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each piece: its document and place there, its sequence and place there."""
    small_batches(docs.sparkSession)
    docs, path = docs.select("doc_id", "text"), path or default_path()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Texts are encoded once; what is counted over all of them, and their keys, come from the ids.
    plain = materialise(docs.mapInArrow(encode(path), PLAIN), "plain-ids")
    idf = counted(plain, encoder(path).library.get_vocab_size())
    ids = materialise(plain.mapInArrow(keyed(idf), ENCODED), "ids")
    release(plain)
    n_ids = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    shards, by = max(1, -(-total // shard_bytes)), [f"key{k}" for k in range(KEYS)]
    dealt = ids.repartitionByRange(shards, *by, "doc_id").sortWithinPartitions(*by, "doc_id", "ids")
    return dealt.mapInArrow(pack_shards(idf, window, n_ids // 4 * 5 // 4 // shards + 1), SCHEMA)


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
