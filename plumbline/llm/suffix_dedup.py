"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``width`` bytes, by passes from the most significant digit on; suffixes
that are still in one group after the last pass are exactly those that start with the same ``width`` bytes.

1. Anchors. The smallest hash of the ``anchor``-byte strings of a window is the same wherever the window stands. Only
   anchors at two places or more can belong to a repeated window; others take no further part.
2. Blocks. Neighbouring windows with the same anchor are cut out together, as one string; equal blocks are one block
   with a count, so that thousands of copies of a text are sorted once.
3. Radix passes. Blocks are dealt by anchor, the first digit; within a task the suffixes at all windows of its
   blocks go through passes of eight bytes each, in which groups of one suffix drop out.
4. An anchor in more than ``HOT_BLOCKS`` different blocks, as a passage shorter than a window in many surroundings gives,
   isn't one task's work. Its blocks are cut by how far before the anchor a window starts, in steps of ``GRAINS``; the
   bytes that all windows of a step share are the next digit, by which these shorter blocks are dealt. Steps of one
   place, at the last, leave nothing but equal windows together.
5. The windows left, and all those of blocks that stand at two places, go back to their places; their union is cut.

Edge cases: a null text is empty; texts shorter than a window keep all; repeated rows repeat each other, as any two
places do; an empty table gives an empty result; other columns are carried along, and columns named like a result are
replaced; a null ``doc_id`` is a value like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import materialise, small_batches, table

WIDTH, ANCHOR = 400, 200
#: Blocks that a task sorts together, in bytes of their strings; a single anchor's blocks are not parted.
SORT_BYTES = 8 << 20
#: Different blocks of one anchor that a task sorts, some 8 MB; those of an anchor with more are cut and dealt anew.
HOT_BLOCKS = 16384
#: Starts that a cut block has, from one cut to the next.
GRAINS = (25, 5, 1)
DIGIT = 8
Batches = Iterator[pa.RecordBatch]


def _anchored(data: np.ndarray, offsets: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every anchor-long string, the smallest of each window, whether the window lies in one text)."""
    g = arrays.window_hashes(data, anchor)
    return g, arrays.sliding(np.minimum, g, width - anchor + 1), arrays.inside_one(offsets, width)


def anchors_of(width: int, anchor: int) -> Callable[[Batches], Batches]:
    """(m, row, n): each text's anchors with the number of places where they are a window's smallest."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            g, m, ok = _anchored(data, offsets, width, anchor)
            # A place is an anchor if it is the smallest of some window around it.
            span = width - anchor + 1
            most = arrays.sliding(np.maximum, np.concatenate([np.zeros(span - 1, np.uint64), np.where(ok, m, 0), np.zeros(span - 1, np.uint64)]), span)
            at = np.flatnonzero(most == g) if len(m) else np.zeros(0, np.int64)
            doc = np.searchsorted(offsets, at, "right") - 1
            order = np.lexsort((g[at], doc))
            doc, value = doc[order], g[at][order]
            first, number = arrays.runs(_pair(doc, value), np.ones(len(doc), bool))
            yield pa.RecordBatch.from_arrays(
                [arrays.as_long(value[first]), batch.column("row").take(pa.array(doc[first])), pa.array(number)], ["m", "row", "n"]
            )

    return run


def _pair(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return arrays.mix(doc.astype(np.uint64)) ^ value


def blocks_of(width: int, anchor: int) -> Callable[[Batches], Batches]:
    """(row, lo, n, m, block): the strings under runs of windows whose anchor is among the row's ``ms``."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            _, m, ok = _anchored(data, offsets, width, anchor)
            lo, n = arrays.runs(m, ok)
            doc = np.searchsorted(offsets, lo, "right") - 1
            wanted = batch.column("ms")
            which = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            good = np.isin(_pair(doc, m[lo]), _pair(which, wanted.flatten().to_numpy().view(np.uint64)))
            lo, n, doc = lo[good], n[good], doc[good]
            length = n + width - 1
            ends = np.concatenate([[0], np.cumsum(length)])
            strings = data[arrays.expand(lo, length)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array(doc)),
                    pa.array(lo - offsets[doc]),
                    pa.array(n),
                    arrays.as_long(m[lo]),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(ends), pa.py_buffer(strings.tobytes())]).cast(pa.binary()),
                ],
                ["row", "lo", "n", "m", "block"],
            )

    return run


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Mask of the suffixes ``starts`` that share their first ``depth`` bytes with another of the same ``group``.

    Passes of ``DIGIT`` bytes from the most significant on; groups whose members all agree in a digit aren't touched,
    and suffixes left alone drop out.
    """
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, DIGIT), (1, 1))
    alive = np.arange(len(starts))
    order = np.argsort(group, kind="stable")
    alive, label = alive[order], group[order]
    at = 0
    while at < depth and len(alive):
        size = min(DIGIT, depth - at)
        raw = np.ascontiguousarray(words[starts[alive] + at])
        if size < DIGIT:
            raw[:, size:] = 0
        digit = raw.view(np.uint64).ravel()
        new = np.ones(len(alive), bool)
        new[1:] = label[1:] != label[:-1]
        head = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        differs = digit != digit[head][number]
        mixed = np.zeros(len(head), bool)
        mixed[number[differs]] = True
        moved = np.flatnonzero(mixed[number])
        if len(moved):
            inner = np.lexsort((digit[moved], number[moved]))
            alive[moved] = alive[moved][inner]
            digit[moved] = digit[moved][inner]
            number_sorted = number[moved][inner]
            # Places of mixed groups stay where they are; only their order inside changes.
            number[moved] = number_sorted
            new[1:] = (number[1:] != number[:-1]) | (mixed[number[1:]] & (digit[1:] != digit[:-1]))
        label = np.cumsum(new)
        size_of = np.bincount(label)
        keep = size_of[label] > 1
        alive, label = alive[keep], label[keep]
        at += size
    out = np.zeros(len(starts), bool)
    out[alive] = True
    return out


def repeated_in_blocks(width: int) -> Callable[[Batches], Batches]:
    """(block_key, spans): the windows of each block that repeat, as runs; blocks come sorted by anchor."""

    def solve(batch: pa.Table) -> pa.RecordBatch:
        data, offsets = arrays.buffer(batch.column("block"))
        anchor = batch.column("m").to_numpy()
        twice = batch.column("places").to_numpy() > 1
        counts = np.diff(offsets) - width + 1
        of = np.repeat(np.arange(len(counts)), counts)
        hit = radix_groups(data, arrays.expand(offsets[:-1], counts), anchor[of], width) | twice[of]
        first = np.cumsum(counts) - counts
        lo, n = arrays.runs(of, hit) if len(of) else (np.zeros(0, np.int64),) * 2
        block = of[lo]
        key = batch.column("key").combine_chunks()
        return pa.RecordBatch.from_arrays([key.take(pa.array(block)), pa.array(lo - first[block]), pa.array(n)], ["key", "at", "n"])

    def run(batches: Batches) -> Batches:
        for whole in arrays.whole_groups(batches, "m", SORT_BYTES):
            yield solve(whole)

    return run


def parts_of(width: int, anchor: int, grain: int) -> Callable[[Batches], Batches]:
    """(key, lo, places, m, block): each block's parts of windows that start within one step of ``grain`` places before
    their anchor; ``m`` is a hash of the bytes that all windows of that step share."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches, "block"):
            data, offsets = arrays.buffer(batch.column("block"))
            counts = np.diff(offsets) - width + 1
            start = arrays.expand(offsets[:-1], counts)
            of = np.repeat(np.arange(len(counts)), counts)
            # The first place of the anchor from each window's start on, which is within the window.
            g = arrays.window_hashes(data, anchor)
            ahead = np.arange(len(g))
            first = np.full(len(data) + 1, len(data))
            is_least = g == batch.column("m").to_numpy().view(np.uint64)[np.minimum(np.searchsorted(offsets, ahead, "right") - 1, len(counts) - 1)]
            first[: len(g)] = np.minimum.accumulate(np.where(is_least, ahead, len(data))[::-1])[::-1]
            step = (first[start] - start) // grain
            new = np.ones(len(start), bool)
            new[1:] = (of[1:] != of[:-1]) | (step[1:] != step[:-1]) | (first[start][1:] != first[start][:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(start)))
            core = first[start[head]] - step[head] * grain
            shared = arrays.window_hashes(data, width - grain + 1)[core]
            m = arrays.mix(shared ^ arrays.mix(step[head].astype(np.uint64)))
            length = n + width - 1
            ends = np.concatenate([[0], np.cumsum(length)])
            strings = data[arrays.expand(start[head], length)]
            block = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(strings.tobytes())])
            which = pa.array(of[head])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(which), pa.array(start[head] - offsets[of[head]]), batch.column("places").take(which), arrays.as_long(m), block.cast(pa.binary())],
                ["key", "lo", "places", "m", "block"],
            )

    return run


def grouped_hits(blocks: DataFrame, width: int, anchor: int, hot_blocks: int, grains: tuple[int, ...] = GRAINS) -> DataFrame:
    """(key, at, n): the runs of repeated windows of distinct ``blocks`` (m, anchor_m, key, places, block), of which those
    that agree in ``m`` are compared; ``anchor_m`` is the anchor's hash."""
    names = blocks.groupBy("m").agg(F.count("*").alias("n"))
    hot = materialise(names.where(F.col("n") > hot_blocks).select("m"), "hot-anchors")
    if not grains or hot.isEmpty():
        dealt = blocks.select("m", "key", "places", "block").repartition("m").sortWithinPartitions("m")
        return dealt.mapInArrow(repeated_in_blocks(width), "key binary, at long, n long")
    few = blocks.join(hot, "m", "left_anti")
    dealt = few.select("m", "key", "places", "block").repartition("m").sortWithinPartitions("m")
    hits = dealt.mapInArrow(repeated_in_blocks(width), "key binary, at long, n long")
    many = blocks.join(hot, "m", "left_semi").select(F.col("anchor_m").alias("m"), "key", "places", "block")
    parts = many.mapInArrow(parts_of(width, anchor, grains[0]), "key binary, lo long, places long, m long, block binary")
    again = many.select("key", F.col("m").alias("anchor_m")).distinct()
    parts = materialise(parts.join(again, "key").withColumn("part", F.unhex(F.md5("block"))), "parts")
    distinct = parts.groupBy("m", "anchor_m", "part").agg(F.sum("places").alias("places"), F.first("block").alias("block"))
    distinct = materialise(distinct.withColumnRenamed("part", "key"), "distinct-parts")
    inner = grouped_hits(distinct, width, anchor, hot_blocks, grains[1:]).select(F.col("key").alias("part"), "at", "n")
    back = parts.select("key", "lo", "part").join(inner, "part")
    return hits.unionByName(back.select("key", (F.col("lo") + F.col("at")).alias("at"), "n"))


def cut_windows(width: int) -> Callable[[Batches], Batches]:
    """The text's bytes without those that the row's ``spans`` of windows cover."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            spans = batch.column("spans")
            which = np.repeat(np.arange(batch.num_rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            gone = arrays.covered(offsets[which] + flat.field("start").to_numpy(), flat.field("n").to_numpy() + width - 1, len(data))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            lo, n = arrays.runs(doc, gone)
            n_spans = np.bincount(doc[lo], minlength=batch.num_rows) if len(lo) else np.zeros(batch.num_rows, np.int64)
            n_removed = np.bincount(doc[lo], weights=n, minlength=batch.num_rows).astype(np.int64) if len(lo) else np.zeros(batch.num_rows, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - n_removed)]).astype(np.int64)
            rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data[~gone].tobytes())])
            names = [c for c in batch.schema.names if c not in ("spans", "row")]
            made = [pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(n_spans.astype(np.int64)), rest.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, "n_bytes", "n_removed", "n_spans", "kept_bytes"])

    return run


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(row, start, n): runs of ``n`` windows from byte ``start`` that also start elsewhere. ``docs``: row, text."""
    anchors = docs.mapInArrow(anchors_of(width, anchor), "m long, row string, n long")
    shared = anchors.groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m")
    shared = materialise(shared, "anchors")
    wanted = anchors.join(shared, "m", "left_semi").groupBy("row").agg(F.collect_set("m").alias("ms"))
    found = docs.join(wanted, "row").select("row", "text", "ms").mapInArrow(blocks_of(width, anchor), "row string, lo long, n long, m long, block binary")
    found = materialise(found.withColumn("key", F.unhex(F.md5("block"))), "blocks")
    distinct = found.groupBy("m", "key").agg(F.count("*").alias("places"), F.first("block").alias("block"))
    hits = grouped_hits(distinct.withColumn("anchor_m", F.col("m")), width, anchor, hot_blocks)
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    hits = materialise(hits, "windows")
    # Equal rows have one set of spans between them.
    members = found.select("row", "lo", "key").distinct().join(hits, "key")
    return members.select("row", "lo", F.explode("runs").alias("r")).select("row", (F.col("lo") + F.col("r.at")).alias("start"), F.col("r.n").alias("n"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept_bytes, the bytes left."""
    small_batches(docs.sparkSession)
    row = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    named = docs.drop("n_bytes", "n_removed", "n_spans", "kept_bytes", "spans", "row").withColumn("row", row)
    found = repeats(named.select("row", "text"), width, anchor, hot_blocks)
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = named.join(found, "row", "left")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("row", "spans")]
    return joined.mapInArrow(cut_windows(width), ", ".join([*fields, "n_bytes long, n_removed long, n_spans long, kept_bytes binary"]))


def op8_radix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


#: Every window of every text by its MD5, in hexadecimal digits.
OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS MATERIALIZED (SELECT row, i, md5_number(substr(h, 2 * i + 1, {2 * WIDTH})) AS k FROM (SELECT row, h, unnest(range(0, length(h) // 2 - {WIDTH - 1})) AS i FROM d WHERE length(h) >= {2 * WIDTH})),
bad AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
new AS (SELECT row, i, CASE WHEN i - lag(i) OVER w <= {WIDTH} THEN 0 ELSE 1 END AS new FROM bad WINDOW w AS (PARTITION BY row ORDER BY i)),
span AS (SELECT row, min(i) AS lo, max(i) + {WIDTH} AS hi FROM (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run FROM new) GROUP BY row, run),
cut AS (SELECT row, lo, hi, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY lo), 0) AS before FROM span),
gone AS (SELECT c.row, sum(hi - lo)::BIGINT AS n, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS h
      FROM cut c JOIN d ON d.row = c.row GROUP BY c.row)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(gone.n, 0)::BIGINT AS n_removed, coalesce(gone.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(gone.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone ON gone.row = d.row
"""
