"""Substring deduplication by compaction of a De Bruijn graph over words.

A window of ``width`` consecutive words is an edge from the node of its first ``width - 1`` words to the node of its
last. Only edges that start in two documents or more are of interest:

1. Anchors. The smallest hash of the ``anchor``-word sequences in a window is the same wherever the window stands, so
   only windows whose anchor occurs in two documents can repeat. Neighbouring windows mostly share their anchor, which
   makes this pass some five times smaller than one over windows.
2. Runs. Documents that hold such anchors give the runs of edges there, as lists of nodes (64-bit hashes; an edge is a
   pair of them). Equal runs are one run with its first place and last document, aggregated before the shuffle.
3. Edges. Distinct runs are dealt by anchor, which all occurrences of an edge share. The smallest (doc_id, place) of a
   repeated edge is its source coordinate; edges of one document alone go, and those whose source coordinates follow on
   from each other stay together as pieces of paths.
   An anchor in more than ``HOT_RUNS`` different runs isn't one task's work: its edges are dealt one by one, by their two
   nodes, and the pieces put together again run by run, of which none has more than ``width`` edges.
4. Compaction. Joins on nodes find those with several edges in or out; paths end there, and pieces are cut.
5. Spans. Occurrences of a run in documents later than its pieces' sources become spans, and spans that go on in step
   with their source coordinates, without a branching node between, are joined to long ones; these are removed.

Edge cases: a null text has no words; documents without ``doc_id`` are neither source nor target of a removal and keep
their words; rows with the same ``doc_id`` don't repeat each other, and each gets the spans of its own text; texts
shorter than a window keep all; an empty table gives an empty result; other columns are carried along, and columns
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import arrays
from plumbline.llm.common import materialise, release, small_batches, table

WIDTH, ANCHOR = 13, 5
#: Distinct runs that a task looks at together, in bytes; one anchor's runs are not parted.
SOLVE_BYTES = 8 << 20
#: Different runs of one anchor that a task looks at, some 8 MB; the edges of an anchor with more are dealt by their nodes.
HOT_RUNS = 50_000
Batches = Iterator[pa.RecordBatch]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, offsets of each text's words)."""
    data, offsets = arrays.buffer(batch.column("text"))
    starts, ends, of = arrays.word_bounds(data, offsets)
    return arrays.word_hashes(data, starts, ends), of


def _anchored(hashes: np.ndarray, of: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, whether it lies in one text) of every window."""
    return arrays.sliding(np.minimum, arrays.window_hashes(hashes, anchor), width - anchor + 1), arrays.inside_one(of, width)


def anchors_of(width: int, anchor: int) -> Callable[[Batches], Batches]:
    """(m, doc_id): the anchors of each document, each once for a document."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            hashes, of = _words(batch)
            m, ok = _anchored(hashes, of, width, anchor)
            first, _ = arrays.runs(m, ok)
            doc = np.searchsorted(of, first, "right") - 1
            doc, m = _distinct(doc, m[first])
            yield pa.RecordBatch.from_arrays([arrays.as_long(m), batch.column("doc_id").take(pa.array(doc))], ["m", "doc_id"])

    return run


def _distinct(doc: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((m, doc))
    doc, m = doc[order], m[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (m[1:] != m[:-1])
    return doc[new], m[new]


def runs_of(width: int, anchor: int) -> Callable[[Batches], Batches]:
    """Runs of windows with one anchor that is among the row's ``ms``: their place, the nodes they pass, one more than
    windows, and two hashes of those."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            hashes, of = _words(batch)
            m, ok = _anchored(hashes, of, width, anchor)
            lo, n = arrays.runs(m, ok)
            doc = np.searchsorted(of, lo, "right") - 1
            wanted = batch.column("ms")
            which = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            mark = arrays.mix(which.astype(np.uint64)) ^ wanted.flatten().to_numpy().view(np.uint64)
            good = np.isin(arrays.mix(doc.astype(np.uint64)) ^ m[lo], mark)
            lo, n, doc = lo[good], n[good], doc[good]
            nodes = arrays.window_hashes(hashes, width - 1)
            keys = [arrays.as_long(arrays.span_hashes(nodes, lo, lo + n + 1, which)) for which in (0, 1)]
            ends = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    batch.column("row").take(pa.array(doc)),
                    pa.array((lo - of[doc]).astype(np.int32)),
                    arrays.as_long(m[lo]),
                    *keys,
                    pa.ListArray.from_arrays(pa.array(ends), arrays.as_long(nodes[arrays.expand(lo, n + 1)])),
                ],
                ["doc_id", "row", "lo", "m", "k1", "k2", "nodes"],
            )

    return run


RUNS = "doc_id long, row long, lo int, m long, k1 long, k2 long, nodes array<long>"
PIECES = "k1 long, k2 long, i int, n int, f_doc long, f_row long, f_home int, f_at int, nodes array<long>"


def repeated_pieces(batches: Batches) -> Batches:
    """For each distinct run, sorted by anchor, the pieces of repeated edges in step with their source coordinates:
    from the run's edge ``i`` on ``n`` edges, which stand first in document ``f_doc`` from ``f_at`` on, in its run that
    begins at ``f_home``. ``nodes`` is empty unless this is that run."""
    for whole in arrays.whole_groups(batches, "m", SOLVE_BYTES):
        run = {c: whole.column(c).to_numpy() for c in ("k1", "k2", "doc_id", "row", "lo", "last")}
        lists = whole.column("nodes").combine_chunks()
        nodes = lists.flatten().to_numpy()
        size = lists.value_lengths().to_numpy()
        base = np.cumsum(size) - size
        r = np.repeat(np.arange(len(size)), size - 1)
        at = arrays.expand(base, size - 1)
        i = at - base[r]
        place = run["lo"][r] + i
        src, dst = nodes[at], nodes[at + 1]
        order = np.lexsort((place, run["row"][r], run["doc_id"][r], dst, src))
        new = np.ones(len(order), bool)
        new[1:] = (src[order[1:]] != src[order[:-1]]) | (dst[order[1:]] != dst[order[:-1]])
        head = np.flatnonzero(new)
        if not len(head):
            continue
        last = np.maximum.reduceat(run["last"][r[order]], head)
        first = np.empty(len(order), np.int64)
        first[order] = order[head][np.cumsum(new) - 1]
        again = np.empty(len(order), bool)
        again[order] = (run["doc_id"][r[order[head]]] < last)[np.cumsum(new) - 1]
        home, f_at = r[first], place[first]
        begin = again.copy()
        begin[1:] &= ~(again[:-1] & (r[1:] == r[:-1]) & (home[1:] == home[:-1]) & (f_at[1:] == f_at[:-1] + 1))
        begin = np.flatnonzero(begin)
        number = np.diff(np.append(np.searchsorted(np.flatnonzero(again), begin), np.count_nonzero(again)))
        own = home[begin] == r[begin]
        length = np.where(own, number + 1, 0)
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        run_of, home = r[begin], home[begin]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(run["k1"][run_of]),
                pa.array(run["k2"][run_of]),
                pa.array(i[begin].astype(np.int32)),
                pa.array(number.astype(np.int32)),
                pa.array(run["doc_id"][home]),
                pa.array(run["row"][home]),
                pa.array(run["lo"][home].astype(np.int32)),
                pa.array(f_at[begin].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes[arrays.expand(at[begin], length)])),
            ],
            ["k1", "k2", "i", "n", "f_doc", "f_row", "f_home", "f_at", "nodes"],
        )


def hot_pieces(runs: DataFrame) -> DataFrame:
    """What :func:`repeated_pieces` gives, by joins on edges. ``runs``: distinct runs (k1, k2, doc_id, row, lo, last, nodes)."""
    edge = F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("src"), F.slice("nodes", 2, F.size("nodes") - 1).alias("dst"))
    edges = runs.select("k1", "k2", "doc_id", "row", "lo", "last", F.posexplode(edge).alias("i", "e")).select("*", "e.src", "e.dst").drop("e")
    edges = materialise(edges, "hot-edges")
    first = F.min(F.struct("doc_id", "row", (F.col("lo") + F.col("i")).alias("at"), F.col("lo").alias("home"))).alias("f")
    again = edges.groupBy("src", "dst").agg(first, F.max("last").alias("z")).where("f.doc_id < z").select("src", "dst", "f")
    found = edges.join(again, ["src", "dst"]).select("k1", "k2", "doc_id", "row", "lo", "i", "f")
    along = Window.partitionBy("k1", "k2").orderBy("i")
    before = F.lag(F.struct("i", "f")).over(along)
    step = (before["i"] + 1 == F.col("i")) & (before["f"]["at"] + 1 == F.col("f.at"))
    same = [before["f"][c] == F.col(f"f.{c}") for c in ("doc_id", "row", "home")]
    marked = found.withColumn("begin", F.when(F.coalesce(step & same[0] & same[1] & same[2], F.lit(False)), None).otherwise(F.col("i")))
    marked = marked.withColumn("begin", F.last("begin", ignorenulls=True).over(along))
    made = marked.groupBy("k1", "k2", "begin").agg(F.count("*").cast("int").alias("n"), F.min(F.struct("i", "f", "doc_id", "row", "lo")).alias("b"))
    made = made.join(runs.select("k1", "k2", "nodes"), ["k1", "k2"])
    own = (F.col("b.f.doc_id") == F.col("b.doc_id")) & (F.col("b.f.row") == F.col("b.row")) & (F.col("b.f.home") == F.col("b.lo"))
    nodes = F.when(own, F.slice("nodes", F.col("begin") + 1, F.col("n") + 1)).otherwise(F.array().cast("array<long>"))
    return made.select(
        "k1", "k2", F.col("begin").alias("i"), "n", F.col("b.f.doc_id").alias("f_doc"), F.col("b.f.row").alias("f_row"), F.col("b.f.home").alias("f_home"), F.col("b.f.at").alias("f_at"), nodes.alias("nodes")
    )


def cut_spans(width: int) -> Callable[[Batches], Batches]:
    """The text without the words that the row's ``spans`` of windows cover."""

    def run(batches: Batches) -> Batches:
        for batch in arrays.pieces(batches):
            data, offsets = arrays.buffer(batch.column("text"))
            starts, ends, of = arrays.word_bounds(data, offsets)
            spans = batch.column("spans")
            which = np.repeat(np.arange(batch.num_rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            at, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            gone = arrays.covered(of[which] + at, n.astype(np.int64) + width - 1, len(starts))
            kept = ~gone
            n_kept = np.add.reduceat(np.append(kept, 0).astype(np.int64), of[:-1]) * (np.diff(of) > 0) if len(kept) else np.zeros(batch.num_rows, np.int64)
            # Every kept word with the blank after it; the last blank of a text is left off below.
            lengths = (ends - starts)[kept] + 1
            out = np.append(data, np.uint8(32))[arrays.expand(starts[kept], lengths)]
            stops = np.cumsum(lengths)
            out[stops - 1] = 32
            per_text = np.concatenate([[0], np.cumsum(n_kept)])
            byte_at = np.concatenate([[0], stops])[per_text]
            keep = np.ones(len(out), bool)
            full = np.diff(byte_at) > 0
            keep[byte_at[1:][full] - 1] = False
            new = np.concatenate([[0], np.cumsum(np.diff(byte_at) - full)]).astype(np.int64)
            texts = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(new), pa.py_buffer(out[keep].tobytes()))
            columns = [batch.column(c) for c in batch.schema.names if c not in ("spans", "row")]
            names = [c for c in batch.schema.names if c not in ("spans", "row")]
            counts = [pa.array(np.diff(of).astype(np.int64)), pa.array(np.diff(of).astype(np.int64) - n_kept), texts.cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*names, "n_words", "n_removed", "kept_text"])

    return run


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, row, start, n, source_doc_id, source_start): spans of ``n`` windows from word ``start`` that stand in
    an earlier document from word ``source_start`` on. ``docs``: doc_id, row (tells texts of one id apart), text."""
    docs = docs.where(F.col("doc_id").isNotNull())
    anchors = docs.select("doc_id", "text").mapInArrow(anchors_of(width, anchor), "m long, doc_id long")
    shared = anchors.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("m")
    shared = materialise(shared, "anchors")
    wanted = anchors.join(shared, "m", "left_semi").groupBy("doc_id").agg(F.collect_set("m").alias("ms"))
    runs = docs.join(wanted, "doc_id").select("doc_id", "row", "text", "ms")
    runs = materialise(runs.mapInArrow(runs_of(width, anchor), RUNS), "runs")
    place = F.min(F.struct("doc_id", "row", "lo")).alias("f")
    distinct = runs.groupBy("m", "k1", "k2").agg(place, F.max("doc_id").alias("last"), F.first("nodes").alias("nodes"))
    distinct = distinct.select("m", "k1", "k2", "f.*", "last", "nodes")
    names = runs.select("m", "k1", "k2").distinct().groupBy("m").agg(F.count("*").alias("n"))
    hot = materialise(names.where(F.col("n") > hot_runs).select("m"), "hot-anchors")
    dealt = distinct.join(hot, "m", "left_anti").repartition("m").sortWithinPartitions("m")
    made = dealt.mapInArrow(repeated_pieces, PIECES)
    if not hot.isEmpty():
        some = runs.join(hot, "m", "left_semi").groupBy("k1", "k2").agg(place, F.max("doc_id").alias("last"), F.first("nodes").alias("nodes"))
        made = made.unionByName(hot_pieces(materialise(some.select("k1", "k2", "f.*", "last", "nodes"), "hot-runs")))
    made = materialise(made, "pieces")
    breaks = materialise(broken(made), "breaks")
    pieces = made.select(*made.columns[:-1]).join(breaks, ["f_doc", "f_row", "f_home"], "left")
    # A piece is cut at the breaks inside it; each part knows whether a path begins with it.
    inside = F.filter(F.coalesce("breaks", F.array().cast("array<int>")), lambda b: (b > F.col("f_at")) & (b < F.col("f_at") + F.col("n")))
    cuts = F.array_sort(F.concat(F.array("f_at"), inside, F.array(F.col("f_at") + F.col("n"))))
    pieces = pieces.select("k1", "k2", "i", "f_doc", "f_row", "f_at", F.coalesce(F.array_contains("breaks", F.col("f_at")), F.lit(False)).alias("new"), cuts.alias("cuts"))
    part = F.expr("inline(transform(sequence(0, size(cuts) - 2), j -> struct(i + cuts[j] - f_at AS at, cuts[j] AS from, cuts[j + 1] - cuts[j] AS n, j > 0 OR new AS begins)))")
    pieces = pieces.select("k1", "k2", "f_doc", "f_row", part)
    # Equal rows have one set of spans between them.
    later = runs.select("doc_id", "row", "lo", "k1", "k2").distinct().join(pieces, ["k1", "k2"]).where("doc_id > f_doc")
    later = later.select("doc_id", "row", (F.col("lo") + F.col("at")).alias("at"), "n", "f_doc", "f_row", F.col("from").alias("f_at"), "begins")
    in_step = Window.partitionBy("doc_id", "row").orderBy("at")
    before = {c: F.lag(c).over(in_step) for c in ("at", "n", "f_doc", "f_row", "f_at")}
    same = (before["at"] + before["n"] == F.col("at")) & (before["f_doc"] == F.col("f_doc")) & (before["f_row"] == F.col("f_row")) & (before["f_at"] + before["n"] == F.col("f_at"))
    marked = later.withColumn("begin", F.when(F.col("begins") | ~F.coalesce(same, F.lit(False)), F.col("at")))
    marked = marked.withColumn("start", F.last("begin", ignorenulls=True).over(in_step))
    spans = marked.groupBy("doc_id", "row", "start").agg(
        F.max(F.col("at") + F.col("n") - F.col("start")).alias("n"), F.min("f_doc").alias("source_doc_id"), F.min("f_at").alias("source_start")
    )
    spans = materialise(spans, "spans")
    release(shared, runs, hot, made, breaks)
    return spans


def broken(pieces: DataFrame) -> DataFrame:
    """(f_doc, f_row, f_home, breaks): the places in each source run at whose first node a path ends, because the graph
    of repeated edges has several edges in or several out there."""
    own = pieces.where("size(nodes) > 0")
    edges = own.select("f_doc", "f_row", "f_home", F.posexplode("nodes").alias("j", "node"), "f_at", "n")
    node = edges.select("node", (F.col("j") > 0).cast("int").alias("n_in"), (F.col("j") < F.col("n")).cast("int").alias("n_out"))
    branching = node.groupBy("node").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).where("n_in > 1 or n_out > 1").select("node")
    at = edges.where("j < n").join(branching, "node", "left_semi").select("f_doc", "f_row", "f_home", (F.col("f_at") + F.col("j")).alias("at"))
    return at.groupBy("f_doc", "f_row", "f_home").agg(F.collect_set("at").alias("breaks"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text, the words left joined by one space."""
    small_batches(docs.sparkSession)
    named = docs.drop("n_words", "n_removed", "kept_text", "row", "spans").withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = repeats(named.select("doc_id", "row", "text"), width, anchor, hot_runs)
    found = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = named.join(found, ["doc_id", "row"], "left")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("row", "spans")]
    return joined.mapInArrow(cut_spans(width), ", ".join([*fields, "n_words long, n_removed long, kept_text string"]))


def op1_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT row, doc_id, i, list_aggregate(w[i : i + {WIDTH - 1}], 'string_agg', chr(10)) AS t
        FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d WHERE len(w) >= {WIDTH})),
first AS (SELECT t, min(doc_id) AS a FROM win GROUP BY t),
bad AS (SELECT DISTINCT win.row, win.i + o.k AS i FROM win JOIN first f ON f.t = win.t AND f.a < win.doc_id, range({WIDTH}) o(k)),
word AS (SELECT row, i, w[i] AS x FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT row, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word WHERE NOT EXISTS
        (SELECT 1 FROM bad WHERE bad.row = word.row AND bad.i = word.i) GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.row = d.row
"""
