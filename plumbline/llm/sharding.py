"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a ring; a row's key hashes to an arc, which belongs to the point at its end.
A shard that is full passes what is left on to the next point clockwise. Only the number of rows of each arc is
needed to see where the overflow goes, so the walk round the ring works on ``shards * vnodes`` counts, whatever the
number of rows; the rows themselves get their rank within their arc and are looked up in the resulting intervals.

With ``slack=0`` capacities add up to exactly the number of rows, so that counts differ by one at most. With a
``slack`` over 0 each shard takes up to ``(1 + slack)`` times the mean, and a row then moves only where its own shard
is full.

Edge cases: an empty table gives an empty result; a null key hashes like any other value (its arc overflows); equal
keys are told apart by ``tie`` columns, and rows equal in all of them are interchangeable; columns named ``shard`` or
``slot`` are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Arcs are cut in so many pieces for ranking, so that no window partition holds a whole arc.
PIECES = 16
#: The ring has 2^16 places, so that the table from place to arc is of bounded size.
RING_BITS = 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. A shard's points depend on its number alone."""
    at = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"{shard}/{v}".encode()).digest()
            at.setdefault(int.from_bytes(digest[:8], "big") >> (64 - RING_BITS), shard)
    return sorted(at.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def settle(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank + 1, shard, first slot) of every interval of rows.

    Each arc first gives its rows to its own shard, in ring order; what a full shard can't take goes on clockwise,
    together with what else arrives there, until it finds room.
    """
    room, used, given = list(room), [0] * len(room), []
    waiting: list[tuple[int, int, int]] = []
    for arc, n in enumerate(counts):
        shard, took = owners[arc], min(n, room[owners[arc]])
        if took:
            given.append((arc, 0, took, shard, used[shard]))
            room[shard] -= took
            used[shard] += took
        if took < n:
            waiting.append((arc, took, n))
    n = len(owners)
    open_at = sorted(i for i in range(n) if room[owners[i]])
    for arc, lo, hi in waiting:
        at = bisect.bisect_right(open_at, arc)
        while lo < hi:
            i = open_at[at % len(open_at)]
            shard = owners[i]
            if not room[shard]:
                open_at = [x for x in open_at if room[owners[x]]]
                at = bisect.bisect_right(open_at, i)
                continue
            took = min(hi - lo, room[shard])
            given.append((arc, lo, lo + took, shard, used[shard]))
            room[shard] -= took
            used[shard] += took
            lo += took
            at += 1
    return given


def arcs(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """(_at, _arc): for each of the ring's places, the number of the first point at or after it, clockwise."""
    rows, before = [], 0
    for i, (at, _) in enumerate(points):
        rows.append((before, at, i))
        before = at + 1
    if before < 1 << RING_BITS:
        rows.append((before, (1 << RING_BITS) - 1, 0))
    spans = spark.createDataFrame(rows, "lo long, hi long, _arc int")
    return spans.select(F.explode(F.sequence("lo", "hi")).alias("_at"), "_arc")


def assign(df: DataFrame, key: str, tie: list[str], shards: int = 16, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, the row's gapless place within its shard.

    ``key`` decides the place on the ring; ``tie`` columns order rows within an arc. All of it is DataFrame
    operations: two shuffles of the rows' arcs (one of them pre-aggregated to counts), and a join with the intervals,
    whose number is bounded by the ring's size.
    """
    spark: SparkSession = df.sparkSession
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes are 1 at least")
    points = ring(shards, vnodes)
    owners = [s for _, s in points]
    at = F.pmod(F.xxhash64(F.lit("ring"), F.col(key)), F.lit(1 << RING_BITS))
    # The rows go as one column, so that none of theirs can clash with those made here.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.drop("shard", "slot").columns]).alias("_row")
    piece = F.pmod(F.xxhash64(F.col(key), *tie), F.lit(PIECES)).cast("int")
    placed = df.select(whole, at.alias("_at"), piece.alias("_piece")).join(F.broadcast(arcs(spark, points)), "_at")
    sizes = {(r["_arc"], r["_piece"]): r["n"] for r in placed.groupBy("_arc", "_piece").agg(F.count("*").alias("n")).collect()}
    counts = [sum(sizes.get((a, p), 0) for p in range(PIECES)) for a in range(len(points))]
    total = sum(counts)
    parts = defaultdict(list)
    for arc, lo, hi, shard, slot in settle(counts, owners, capacities(total, shards, slack)):
        parts[arc].append((lo, hi, shard, slot))
    pieces = []
    for a in range(len(points)):
        before = 0
        for p in range(PIECES):
            n = sizes.get((a, p), 0)
            for lo, hi, shard, slot in parts[a]:
                lo_, hi_ = max(lo, before), min(hi, before + n)
                if lo_ < hi_:
                    pieces.append((a, p, lo_ - before, hi_ - before, shard, slot + lo_ - lo))
            before += n
    intervals = spark.createDataFrame(pieces or [(-1, -1, 0, 0, 0, 0)], "_arc int, _piece int, _lo long, _hi long, shard int, _slot long")
    order = Window.partitionBy("_arc", "_piece").orderBy("_at", *[F.col("_row")[c] for c in (key, *tie)])
    ranked = placed.withColumn("_rank", (F.row_number().over(order) - 1).cast("long"))
    out = ranked.join(F.broadcast(intervals), ["_arc", "_piece"]).where("_rank >= _lo and _rank < _hi")
    return out.select("_row.*", "shard", (F.col("_slot") + F.col("_rank") - F.col("_lo")).alias("slot"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by ``doc_id``, with counts at most one apart (law ``rows``)."""
    from plumbline.llm.common import table, text_bytes

    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(text_bytes(F.col("text"))).alias("text_crc32"),
    )
    return assign(docs, "doc_id", ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
