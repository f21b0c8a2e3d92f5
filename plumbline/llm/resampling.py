"""Importance resampling towards a target: hashed word and word-pair features, gains by bucket, draws by a Gumbel key.

Tasks hold tries of the words of their texts. A node below the root is a word, a node below that the word after it; each
holds the CRC-32 of its path, which a child carries on from its parent's, so that no feature's text is put together. In the
first pass nodes count how often they are passed, and a task gives the sums of its buckets; in the second each node has its
bucket's gain, and a document's sum is gathered on its walk. A trie holds some ``TRIE_BYTES`` of a task's texts, as arrays, before
its counts are merged into the task's, so that memory is bounded and nothing is lost; a longer text has several. Words are
told apart by 64-bit hashes within a trie.

Only the bucket sums (``BUCKETS`` rows) and the number of eligible documents reach the driver. Ranks come from counts by
score, added up in two steps (blocks of scores, scores of a block), and from the order of the doc_ids of one score.

Edge cases: a null text has no words; a null ``doc_id`` hashes as an empty string and comes last among ties; repeated rows
each count and get ranks of their own; an empty table gives no rows, an empty target equal counts of none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import materialise, small_batches, table

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Text bytes of one trie, some 100 bytes of memory each.
TRIE_BYTES = 4 << 20
#: Bytes of a word up to which many words' sums are carried on side by side.
SHORT = 48
#: Scores of a block of the running counts.
BLOCK = 256
#: A byte in lower case, blank where it is part of no word.
LOWERED = np.full(256, 0x20, np.uint8)
for _first, _last, _shift in ((0x30, 0x39, 0), (0x61, 0x7A, 0), (0x80, 0xFF, 0), (0x41, 0x5A, 0x20)):
    LOWERED[_first : _last + 1] = np.arange(_first, _last + 1) + _shift
Batches = Iterator[pa.RecordBatch]


def crc_table() -> np.ndarray:
    """What each byte adds to a CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = crc_table()


def carried(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each path that had come to ``state`` and goes on with ``data[start:end]``."""
    out = state.astype(np.uint32)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    todo = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    left, at, c = sizes[todo], starts[todo], ~out[todo]
    for k in range(SHORT):
        n = int(np.searchsorted(-left, -k, "left"))  # those longer than k
        if not n:
            break
        c[:n] = CRC_TABLE[(c[:n] ^ data[at[:n] + k]) & 0xFF] ^ (c[:n] >> np.uint32(8))
    out[todo] = ~c
    return out


class Trie:
    """The words of some texts, and the pairs of words: for each node the CRC-32 of its path and how often it is passed, and
    each text's walk. Nodes of words come first; ``skip`` leaves out the first word itself, not what follows it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, skip: bool = False):
        starts, ends, self.of = arrays.word_bounds(data, offsets)
        _, first, self.word = np.unique(arrays.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        n = len(first)
        words = carried(np.zeros(n, np.uint32), data, starts[first], ends[first])
        # A pair stands where its first word does; a text's last word begins none.
        self.follows = np.ones(max(len(self.word) - 1, 0), bool)
        inner = self.of[1:-1]
        self.follows[inner[(inner > 0) & (inner < len(self.word))] - 1] = False
        pair = (self.word[:-1] * n + self.word[1:])[self.follows]
        below, self.pair, passed = np.unique(pair, return_inverse=True, return_counts=True)
        parent, child = (below // n, below % n) if n else (below, below)
        blank = carried(words[parent], np.full(len(below), 0x20, np.uint8), np.arange(len(below)), np.arange(1, len(below) + 1))
        self.state = np.concatenate([words, carried(blank, data, starts[first][child], ends[first][child])]).astype(np.int64)
        self.counts = np.concatenate([np.bincount(self.word[int(skip) :], minlength=n), passed])
        self.n_words = n
        self.skip = skip and len(self.word) > 0
        self.last = (int(starts[-1]), int(ends[-1])) if len(starts) else None

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the gains, number of features) of each text, gathered on its walk; ``gains`` of each node."""
        words, pairs = np.zeros(len(self.word) + 1, np.int64), np.zeros(len(self.word) + 1, np.int64)
        np.cumsum(gains[self.word], out=words[1:])
        pairs[1:-1][self.follows] = gains[self.n_words + self.pair]
        number = np.zeros(len(self.word) + 1, np.int64)
        number[1:-1] = self.follows
        pairs, number = np.cumsum(pairs), np.cumsum(number)
        total, n = np.diff(words[self.of]), np.diff(self.of)
        # None leads from one text's last word to the next one's first.
        total += pairs[self.of[1:]] - pairs[self.of[:-1]]
        n += number[self.of[1:]] - number[self.of[:-1]]
        if self.skip:
            total[0] -= gains[self.word[0]]
            n[0] -= 1
        return total, n


def tries(batch: pa.RecordBatch, size: int) -> Iterator[tuple[Trie, bool]]:
    """(trie of a batch's texts, False), or for one long text its stretches' tries with whether more is to come: each goes on
    with the last word of the one before."""
    data, offsets = arrays.buffer(batch.column(batch.schema.get_field_index("text")))
    if len(data) <= 2 * size:
        yield Trie(LOWERED[data], offsets), False
        return
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        start = stop = a
        skip = False
        while stop < b or stop == a:
            stop = min(b, stop + size)
            while stop < b and LOWERED[data[stop]] != 0x20:  # to the end of a word, however long
                more = np.flatnonzero(LOWERED[data[stop : stop + size]] == 0x20)
                stop = stop + int(more[0]) if len(more) else min(b, stop + size)
            trie = Trie(LOWERED[data[start:stop]], np.array([0, stop - start]), skip)
            yield trie, stop < b
            if stop == a:
                break
            skip = trie.last is not None
            start = start + trie.last[0] if skip else stop


def count_batches(buckets: int, size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        sums = np.zeros(buckets, np.int64)
        for batch in arrays.pieces(batches, most=size):
            for trie, _ in tries(batch, size):
                np.add.at(sums, trie.state % buckets, trie.counts)
        kept = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(sums[kept])], ["bucket", "n"])

    return run


def weigh_batches(gains: np.ndarray, size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches, most=size):
            totals, numbers, going_on = [], [], False
            for trie, more in tries(batch, size):
                total, n = trie.sums(gains[trie.state % len(gains)])
                if going_on:
                    totals[-1], numbers[-1] = totals[-1] + total, numbers[-1] + n
                else:
                    totals.append(total)
                    numbers.append(n)
                going_on = more
            total, n = np.concatenate(totals), np.concatenate(numbers)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            doc_id = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array((n + 1) // 2), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def bucket_sums(docs: DataFrame, buckets: int = BUCKETS, size: int = TRIE_BYTES) -> DataFrame:
    """(bucket, n): features of all texts by bucket, those without any left out."""
    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(count_batches(buckets, size), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: a thousand times the logarithm of how much more often the target has it, smoothed by one."""
    both = bucket_sums(docs, buckets).withColumn("of", F.lit(0)).union(bucket_sums(target, buckets).withColumn("of", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for bucket, n, of in both.collect():  # two rows a bucket at most
        counts[of, bucket] = n
    (s, t), (all_s, all_t) = counts.tolist(), counts.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(all_s + buckets) / (float(a + 1) * float(all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, size: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a text's features."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh_batches(gain, size), "doc_id long, n_words long, n_features long, weight long")


def keyed(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with ``score``: its weight and a Gumbel key of the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: that of the drawn rows, ``percent`` of those with enough words, by falling score."""
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    able = F.when(F.col("n_words") >= least_words, F.col("score"))
    scored = scored.withColumn("able", able)
    levels = materialise(scored.where("able IS NOT NULL").groupBy("able").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("able") / BLOCK)), "levels")
    wanted = percent * (levels.agg(F.sum("n")).first()[0] or 0) // 100
    blocks = levels.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", before(Window.orderBy(F.desc("block")), "n").alias("above"))  # scores span some hundred thousand
    inside = Window.partitionBy("block").orderBy(F.desc("able"))
    cut = levels.join(blocks, "block").select("able", (F.col("above") + before(inside, "n")).alias("above")).where(F.col("above") < wanted)
    fields = ["doc_id", "n_words", "n_features", "weight", "score"]
    # Equal rows are one until they have their ranks.
    rows = scored.where("able IS NOT NULL").groupBy(*fields, "able").agg(F.count("*").alias("n")).join(cut, "able")
    order = Window.partitionBy("able").orderBy(F.asc_nulls_last("doc_id"), "n_features", "n_words")
    first = F.col("above") + before(order, "n") + 1
    ranked = rows.withColumn("first", first).select(*fields, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.join(cut, "able", "left_anti").select(*fields, F.lit(None).cast("long").alias("rank"))
    return ranked.union(rest)


def op13_trie_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = materialise(keyed(weigh(docs, gains(docs, table(spark, sf_dir, "benchmark")))), "scores")
    return draw(scored).drop("n_words")


#: The sum of a feature's bytes is worked out from a table that a rule gives.
OP13_SQL = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) x(i)),
texts AS (SELECT row_number() OVER () AS row, doc_id, false AS target, text FROM documents
      UNION ALL SELECT -row_number() OVER (), NULL, true, text FROM benchmark),
w AS (SELECT row, doc_id, target,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT row, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket FROM names, crc),
used AS (SELECT row, target, bucket, count(*) AS n FROM f JOIN buckets USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM used GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + {BUCKETS}) / ((s + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain FROM sums, totals),
weights AS (SELECT row, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM used JOIN gain USING (bucket) WHERE NOT target GROUP BY row),
d AS (SELECT doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
      FROM w LEFT JOIN weights USING (row) WHERE NOT target),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
able AS (SELECT *, n_words >= {LEAST_WORDS} AS able,
        row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, n_words) AS r,
        count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM able
"""
