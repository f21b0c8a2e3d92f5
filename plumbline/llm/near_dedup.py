"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Signatures (Christiani, 2020): every element, here a five-word shingle weighted by the number of times it stands in the
text, is the origin of a plane of weight and rank on which hashed darts fall, one for each unit of area on average, each with one of ``K`` coordinates. A document keeps the
darts below its elements' weights and below a rank that lets about ``K ln K + 2 K`` of them through, whatever the
document's size; the earliest dart of each coordinate is the signature. Two signatures agree in a coordinate with the
weighted Jaccard similarity of the documents as probability. Regions of doubling weight and rank have a Poisson number
of darts each, so an element only looks at regions that its document can reach.

Joining: exact copies are one node. ``BANDS`` bands of ``ROWS`` coordinates put nodes into buckets; a pair of
similarity 0.8 shares one with probability over 0.9999999. Within a bucket no pairs are listed:

1. Each node is compared with the bucket's most central one, that with the largest buckets in all bands; pairs whose
   shingles reach the threshold are linked, and connected components are taken.
2. In buckets of several components, a node of which less than the threshold's share of shingles stands in other
   components has no link there, whatever the partner, and leaves the bucket.
3. What is left falls into zones, nodes joined by sharing such buckets. A zone is cut in blocks of ``BLOCK`` nodes, and
   each pair of blocks is a task's work: every node outside the largest component there looks its shingles up in an
   inverted index of the blocks and gives the links that reach the threshold, one for each other component.

A pair is thus compared, or ruled out by its shingles, or in one component already; only links leave a task.

Edge cases: a text of fewer than five words is one shingle; null and blank texts have none, and only equal ones are
copies of each other; rows of one ``doc_id`` with different texts are classed by their texts; rows without ``doc_id`` have a null class; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import materialise, small_batches, table
from plumbline.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
K = BANDS * ROWS
#: Darts that a document lets through on average.
DARTS = K * math.log(K) + 2 * K
#: The first region of rank; each further one is as wide as all before it.
FIRST_RANK = 2.0**-8
#: Nodes of a block, of which a task holds two, and bytes of text that a task takes at once.
BLOCK, ZONE_BYTES = 1000, 8 << 20
Batches = Iterator[pa.RecordBatch]


def shingles(column: pa.Array, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of each distinct shingle of each text. ``weights``: ``set`` (1 each) or ``count``."""
    data, offsets = arrays.buffer(column)
    starts, ends, of = arrays.word_bounds(data, offsets)
    words = arrays.word_hashes(data, starts, ends)
    full = arrays.window_hashes(words, SHINGLE)
    ok = arrays.inside_one(of, SHINGLE)
    row = np.searchsorted(of, np.arange(len(full)), "right") - 1
    short = np.flatnonzero((np.diff(of) > 0) & (np.diff(of) < SHINGLE))
    row = np.concatenate([row[ok], short])
    value = np.concatenate([full[ok], arrays.span_hashes(words, of[short], of[short + 1])])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row))) if weights == "count" else np.ones(len(first), np.int64)
    return row[first], value[first], count


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=4096)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts; from logarithms, as the first ones may be too small for a number."""
    k = np.arange(40 + int(4 * mean))
    steps = np.log(np.maximum(k, 1)).cumsum()
    return np.minimum(np.exp(k * math.log(mean) - mean - steps).cumsum(), 1.0)


def darts(row: np.ndarray, value: np.ndarray, weight: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, coordinate, rank, dart) of the darts under each element's weight and its row's ``reach``, by region. Each
    region looks only at the elements that reach it, so that a few heavy ones cost little."""
    far = reach[row]
    heavy, w_lo, w_hi, v = np.arange(len(row)), 0.0, 1.0, 0
    while len(heavy):
        use, r_lo, r_hi, r = heavy[far[heavy] > 0], 0.0, FIRST_RANK, 0
        while len(use):
            h = arrays.mix(value[use] ^ np.uint64((v << 32 | r) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            number = np.searchsorted(_poisson((w_hi - w_lo) * (r_hi - r_lo)), _unit(h), "right")
            some = np.flatnonzero(number)
            which = np.repeat(some, number[some])
            dart = arrays.mix(h[which] + arrays.expand(np.ones(len(some), np.int64), number[some]).astype(np.uint64) * np.uint64(arrays.BASES[0]))
            rank = r_lo + (r_hi - r_lo) * _unit(dart)
            dart = arrays.mix(dart ^ np.uint64(arrays.BASES[1]))
            height = w_lo + (w_hi - w_lo) * _unit(dart)
            element = use[which]
            good = (height < weight[element]) & (rank <= far[element])
            dart = arrays.mix(dart[good] ^ np.uint64(arrays.BASES[0]))
            yield row[element[good]], (dart % np.uint64(K)).astype(np.int64), rank[good], dart
            r_lo, r_hi, r = r_hi, r_hi * 2, r + 1
            use = use[far[use] > r_lo]
        w_lo, w_hi, v = w_hi, w_hi * 2, v + 1
        heavy = heavy[weight[heavy] > w_lo]


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x K: the earliest dart of each coordinate; rows without elements keep zeros."""
    total = np.bincount(row, weights=weight, minlength=n)
    reach = np.divide(DARTS, total, out=np.zeros(n), where=total > 0)
    best, sign = np.full(n * K, np.inf), np.zeros(n * K, np.uint64)
    todo = total > 0
    while todo.any():
        use = todo[row]
        for r, j, rank, dart in darts(row[use], value[use], weight[use], reach):
            at = r * K + j
            np.minimum.at(best, at, rank)
            hit = best[at] == rank
            sign[at[hit]] = dart[hit]
        # A coordinate without a dart: the row reaches twice as far.
        todo = todo & np.isinf(best.reshape(n, K)).any(1)
        reach = np.where(todo, reach * 2, 0)
    return sign.reshape(n, K)


def bands_of(weights: str) -> Callable[[Batches], Batches]:
    """(doc_id, copy, bands): a hash for each band of the text's signature; no bands for blank texts."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            row, value, weight = shingles(batch.column("text"), weights)
            n = batch.num_rows
            if len(row):
                sign = signatures(row, value, weight.astype(np.float64), n).reshape(n, BANDS, ROWS)
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
                for k in range(ROWS):
                    h = arrays.mix((h ^ sign[:, :, k]) * np.uint64(arrays.BASES[0]))
            else:
                h = np.zeros((n, BANDS), np.uint64)
            some = np.bincount(row, minlength=n) > 0
            ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), arrays.as_long(h[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), bands], ["doc_id", "copy", "bands"])

    return run


def similar_pairs(threshold: float, weights: str) -> Callable[[Batches], Batches]:
    """Of rows (a, b, text_a, text_b) the pairs (a, b) whose texts' shingles reach the similarity."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(arrays.pieces(batches, "text_a"), "text_b"):
            ra, va, wa = shingles(batch.column("text_a"), weights)
            rb, vb, wb = shingles(batch.column("text_b"), weights)
            n = batch.num_rows
            row, value, weight = np.concatenate([ra, rb]), np.concatenate([va, vb]), np.concatenate([wa, wb])
            order = np.lexsort((value, row))
            row, value, weight = row[order], value[order], weight[order]
            same = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
            both = np.bincount(row[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=n)
            any_ = np.bincount(row, weights=weight, minlength=n) - both
            good = np.flatnonzero((any_ > 0) & (both >= threshold * any_ - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good))], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, weights: str) -> DataFrame:
    """The links among ``pairs`` (a, b). ``texts``: (node, text)."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(similar_pairs(threshold, weights), "a long, b long")


def mixed(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, node, part): the rows of buckets of several components."""
    named = buckets.select("bucket", "node").join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    several = named.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    return named.join(several.select("bucket"), "bucket", "left_semi")


def shingles_of(weights: str) -> Callable[[Batches], Batches]:
    """(node, part, h, w, total): each text's shingles with their weights, and the sum of those."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            row, value, weight = shingles(batch.column("text"), weights)
            total = np.bincount(row, weights=weight, minlength=batch.num_rows).astype(np.int64)
            taken = [batch.column(c).take(pa.array(row)) for c in ("node", "part")]
            yield pa.RecordBatch.from_arrays([*taken, arrays.as_long(value), pa.array(weight), pa.array(total[row])], ["node", "part", "h", "w", "total"])

    return run


def may_link(open_: DataFrame, texts: DataFrame, threshold: float, weights: str) -> DataFrame:
    """The rows of ``open_`` (bucket, node, part) whose node could have a link to another component: at least the
    threshold's share of its shingles stands in other components. A link needs that, since the shingles in common are
    at most those, and all of both texts are at least the node's own."""
    nodes = open_.select("node", "part").distinct()
    parts = texts.join(nodes, "node").select("node", "part", "text").mapInArrow(shingles_of(weights), "node long, part long, h long, w long, total long")
    parts = materialise(parts, "shingles")
    wide = parts.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("h")
    could = parts.join(wide, "h", "left_semi").groupBy("node").agg(F.sum("w").alias("w"), F.max("total").alias("total"))
    return open_.join(could.where(F.col("w") >= threshold * F.col("total") - 1e-9).select("node"), "node", "left_semi")


def cross_links(threshold: float, weights: str) -> Callable[[Batches], Batches]:
    """Of rows (g, node, part, side, text), sorted by g, links (a, b) between nodes of one g and several parts: within
    side 2, or from side 0 to side 1."""

    def run(batches: Batches) -> Batches:
        for whole in arrays.whole_groups(batches, "g", ZONE_BYTES):
            g, node, part, side = (whole.column(c).to_numpy() for c in ("g", "node", "part", "side"))
            row, value, weight = shingles(whole.column("text").combine_chunks(), weights)
            total = np.bincount(row, weights=weight, minlength=len(g))
            _, group = np.unique(g, return_inverse=True)
            key = arrays.mix(group.astype(np.uint64)[row]) ^ value
            order = np.argsort(key, kind="stable")
            posted, posted_w, sorted_key = row[order], weight[order], key[order]
            lo, hi = np.searchsorted(sorted_key, key, "left"), np.searchsorted(sorted_key, key, "right")
            first = np.searchsorted(row, np.arange(len(g) + 1))
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(starts[1:], len(g))
            links: list[tuple[int, int]] = []
            for a, z in zip(starts, ends, strict=True):
                names, sizes = np.unique(part[a:z], return_counts=True)
                if len(names) < 2:
                    continue
                for x in np.flatnonzero(part[a:z] != names[sizes.argmax()]) + a:
                    s = slice(first[x], first[x + 1])
                    place = arrays.expand(lo[s], hi[s] - lo[s])
                    least = np.minimum(np.repeat(weight[s], hi[s] - lo[s]), posted_w[place])
                    both = np.bincount(posted[place] - a, weights=least, minlength=z - a)
                    other = (part[a:z] != part[x]) & ((side[x] == 2) | (side[a:z] != side[x]))
                    hit = np.flatnonzero(other & (both > 0) & (both >= threshold * (total[a:z] + total[x] - both) - 1e-9)) + a
                    if len(hit):
                        _, one = np.unique(part[hit], return_index=True)
                        links += [(int(node[x]), int(node[y])) for y in hit[one]]
            pairs = np.sort(np.array(links, np.int64).reshape(-1, 2), 1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def zone_links(open_: DataFrame, texts: DataFrame, threshold: float, weights: str) -> DataFrame:
    """(a, b): links between nodes of different parts that are joined by buckets of ``open_`` (bucket, node, part)."""
    open_ = materialise(open_, "zones")
    heads = open_.groupBy("bucket").agg(F.min("node").alias("head"))
    zones = components(open_.join(heads, "bucket").select(F.col("head").alias("a"), F.col("node").alias("b")))
    nodes = open_.select("node", "part").distinct().join(zones.withColumnRenamed("component", "zone"), "node")
    blocks = nodes.groupBy("zone").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = nodes.join(blocks, "zone").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    dealt = placed.select(F.xxhash64("zone", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "node", "part", side.alias("side"))
    rows = dealt.join(texts, "node").select("g", "node", "part", "side", "text").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(cross_links(threshold, weights), "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "count") -> DataFrame:
    """(doc_id, copy, class_id) of every row: the MD5 of its text, and the smallest doc_id of that text's component of links.
    Texts link where the weighted Jaccard similarity of their shingles, by ``count`` or with every weight 1 (``set``), is
    ``threshold`` or more. Different texts of one doc_id may be of different classes."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.md5("text"))
    signed = materialise(docs.mapInArrow(bands_of(weights), "doc_id long, copy string, bands array<long>"), "signatures")
    nodes = signed.groupBy("copy").agg(F.min("doc_id").alias("node")).where("node is not null")
    nodes = materialise(nodes, "nodes")
    own = signed.join(nodes, (signed["copy"] == nodes["copy"]) & (signed["doc_id"] == nodes["node"]), "left_semi")
    buckets = own.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialise(buckets.join(shared, "bucket"), "buckets")
    central = buckets.groupBy("node").agg(F.sum("n").alias("central"))
    best = buckets.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", (-F.col("node")).alias("minus"))).alias("h"))
    heads = best.select("bucket", (-F.col("h.minus")).alias("head"))
    pairs = buckets.join(heads, "bucket").where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "copy", "text").join(nodes, ["node", "copy"], "left_semi").dropDuplicates(["node", "copy"])
    texts = texts.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "text")
    texts = materialise(texts, "texts")
    links = materialise(verified(pairs, texts, threshold, weights), "links")
    groups = components(links)
    open_ = materialise(may_link(mixed(buckets, groups), texts, threshold, weights), "open")
    more = materialise(zone_links(mixed(open_, groups), texts, threshold, weights), "more")
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    named = nodes.join(groups, "node", "left").select("copy", F.coalesce("component", "node").alias("class_id"))
    members = signed.select("doc_id", "copy").join(named, "copy", "left")
    return members.select("doc_id", "copy", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, named by its smallest doc_id."""
    return classes(table(spark, sf_dir, "documents")).drop("copy")
