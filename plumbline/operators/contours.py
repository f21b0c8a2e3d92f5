"""Contours: the crossings of level sets with a raster's grid edges, and their chains in order.

A crossing is named by its grid edge, so that chaining compares integers and never places. Chains that stay within a tile of
``TILE`` by ``TILE`` cells are walked there, many tiles side by side. Those that cross a tile's border are ranked by pointer
doubling: every stretch between two crossings is two darts, one each way; in each round a dart jumps as far again as it has
come, so that a chain of n crossings takes log2(n) rounds of joins, whatever its shape and wherever its rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.rounds import materialise, release

#: Sides of a cell that a contour joins, by which corners are high (1 top left, 2 top right, 4 bottom right, 8 bottom
#: left); sides are 0 top, 1 right, 2 bottom, 3 left. Cells with two opposite high corners depend on their middle.
PLAIN = {1: (0, 3), 2: (0, 1), 3: (1, 3), 4: (1, 2), 6: (0, 2), 7: (2, 3), 8: (2, 3), 9: (0, 2), 11: (1, 2), 12: (1, 3), 13: (0, 1), 14: (0, 3)}
AROUND_TOP_LEFT, AROUND_TOP_RIGHT = ((0, 3), (1, 2)), ((0, 1), (2, 3))
#: Cells along a tile's side, and stretches that are walked at once, where a single tile hasn't more.
TILE, SIDE_BY_SIDE = 128, 1 << 18


def segments(raster: DataFrame, levels: list[float], w: int) -> DataFrame:
    """(img, ix, iy, level, a, b, xa, ya, xb, yb): the stretches of each level's contour within cells, between the crossings of grid
    edges ``a < b``. The edge right of pixel (ix, iy) is 2 (iy w + ix), the one below it is one more; places count from 1."""
    row, column = Window.partitionBy("img", "iy").orderBy("ix"), Window.partitionBy("img", "ix").orderBy("iy")
    next_ = lambda value, along, order: F.when(F.lead(along).over(order) == F.col(along) + 1, F.lead(value).over(order))
    cells = raster.select("img", "ix", "iy", F.col("v").cast("double").alias("tl")).withColumn("tr", next_("tl", "ix", row))
    cells = cells.withColumn("bl", next_("tl", "iy", column)).withColumn("br", next_("tr", "iy", column)).where("tr is not null and bl is not null and br is not null")
    spread = F.filter(F.array(*map(F.lit, levels)), lambda c: (c > F.least("tl", "tr", "bl", "br")) & (c <= F.greatest("tl", "tr", "bl", "br")))
    cells = cells.withColumn("level", F.explode(spread))
    level = F.col("level")
    case = sum((F.when(F.col(c) >= level, k).otherwise(0) for c, k in (("tl", 1), ("tr", 2), ("br", 4), ("bl", 8))), F.lit(0))
    middle = (F.col("tl") + F.col("tr") + F.col("bl") + F.col("br")) / 4 >= level
    pairs = lambda p: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in p])
    sides = F.when((F.col("case") == 5) == middle, pairs(AROUND_TOP_RIGHT)).otherwise(pairs(AROUND_TOP_LEFT))
    for k, p in PLAIN.items():
        sides = F.when(F.col("case") == k, pairs([p])).otherwise(sides)
    share = lambda a, b: (level - F.col(a)) / (F.col(b) - F.col(a))
    x, y, k = F.col("ix") + 1.0, F.col("iy") + 1.0, 2 * (F.col("iy").cast("long") * w + F.col("ix"))
    crossed = {0: (k, x + share("tl", "tr"), y), 1: (k + 3, x + 1, y + share("tr", "br")), 2: (k + 2 * w, x + share("bl", "br"), y + 1), 3: (k + 1, x, y + share("tl", "bl"))}

    def at(side: Column, i: int) -> Column:
        return F.when(side == 0, crossed[0][i]).when(side == 1, crossed[1][i]).when(side == 2, crossed[2][i]).otherwise(crossed[3][i])

    cells = cells.withColumn("case", case).withColumn("s", F.explode(sides))
    ends = [at(F.col(f"s.{c}"), i).alias(n) for c in "ab" for i, n in enumerate((c, f"x{c}", f"y{c}"))]
    made = cells.select("img", "ix", "iy", "level", *ends)
    turned = F.col("a") > F.col("b")
    swap = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    return made.select("img", "ix", "iy", "level", *[swap(*c).alias(c[0]) for c in (("a", "b"), ("b", "a"), ("xa", "xb"), ("ya", "yb"), ("xb", "xa"), ("yb", "ya"))])


def ranked(darts: DataFrame, by: list[str], loops_at_least: bool) -> DataFrame:
    """``darts`` (by, u, v, nu, nv) with ``r``, the darts from here to the chain's end or so far round a loop, ``t``, the last
    dart's head, ``x``, its tail, ``m``, the least node met, and ``open``: whether there is an end at all."""
    done = materialise(darts.select(*by, "u", "v", "nu", "nv", F.lit(1).cast("long").alias("r"), F.least("u", "v").alias("m"), F.col("u").alias("x"), F.col("v").alias("t")))
    while True:
        ahead = done.select(*by, F.col("u").alias("nu"), F.col("v").alias("nv"), *[F.col(c).alias(f"_{c}") for c in ("nu", "nv", "r", "m", "x", "t")])
        far = done.where("nu is not null").join(ahead, [*by, "nu", "nv"])
        moved = far.select(*by, "u", "v", F.col("_nu").alias("nu"), F.col("_nv").alias("nv"), (F.col("r") + F.col("_r")).alias("r"), F.least("m", "_m").alias("m"), F.col("_x").alias("x"), F.col("_t").alias("t"), (F.col("_nu").isNull() | (F.col("_m") < F.col("m"))).alias("news"))
        after = materialise(moved.unionByName(done.where("nu is null").withColumn("news", F.lit(False))))
        release(done)
        done = after.drop("news")
        # No dart has come to an end, and none has met a smaller node: what goes on is loops, and they have been round.
        if after.where("news" if loops_at_least else "nu is not null").isEmpty():
            return done.withColumn("open", F.col("nu").isNull())


def linked(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, line, seq, node, closed): the chains of ``links`` (by, a, b), whose nodes have one or two links each.

    An open chain is named by its smaller end and starts there; a loop by its smallest node, goes to that one's smaller
    neighbour first, and has its first node again at its end.
    """
    ends = links.select(*by, "a", "b")
    darts = ends.select(*by, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(ends.select(*by, F.col("b").alias("u"), F.col("a").alias("v")))
    near = darts.groupBy(*by, "u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    other = F.when(F.col("lo") == F.col("u"), F.col("hi")).otherwise(F.col("lo"))
    after = darts.join(near.withColumnRenamed("u", "v"), [*by, "v"])
    after = after.withColumn("nv", F.when(F.col("lo") != F.col("hi"), other)).select(*by, "u", "v", F.when(F.col("nv").isNotNull(), F.col("v")).alias("nu"), "nv")
    start = materialise(after)
    first = ranked(start, by, True)
    # A loop is cut at its smallest node, in both directions.
    cut = first.where("not open").select(*by, "u", "v", "m").join(start, [*by, "u", "v"])
    stop = lambda c: F.when(F.col("v") != F.col("m"), F.col(c)).alias(c)
    second = ranked(cut.select(*by, "u", "v", stop("nu"), stop("nv")), by, False)
    fields = [*by, "u", "v", "r", "t", "x", "closed"]
    both = first.where("open").withColumn("closed", F.lit(False)).select(*fields).unionByName(second.withColumn("closed", F.lit(True)).select(*fields))
    back = both.select(*by, F.col("u").alias("v"), F.col("v").alias("u"), F.col("r").alias("come"), F.col("t").alias("line"), F.col("x").alias("back_x"))
    ways = both.join(back, [*by, "u", "v"])
    taken = ways.where(F.when(F.col("closed"), F.col("x") > F.col("back_x")).otherwise(F.col("line") < F.col("t")))
    tail = F.struct((F.col("come") - 1).alias("seq"), F.col("u").alias("node"))
    last = F.struct(F.col("come").alias("seq"), F.col("v").alias("node"))
    nodes = F.explode(F.when(F.col("r") == 1, F.array(tail, last)).otherwise(F.array(tail)))
    return taken.select(*by, "line", "closed", nodes.alias("n")).select(*by, "line", "n.seq", "n.node", "closed")


def walked(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chain, closed, first, seq, dart) of the stretches ``a`` to ``b``, whose nodes have one or two of them within their
    ``group``: chains as :func:`linked` has them, all of them a step at a time. Dart i goes along stretch i, and i + len(a)
    back; ``chain`` numbers the chains, whose ``closed`` and ``first`` dart are given, and ``seq`` is a dart's place in it."""
    n = len(a)
    tail, head = np.concatenate([a, b]), np.concatenate([b, a])
    node = np.unique(np.concatenate([group, group]) * (tail.max() + 1) + tail, return_inverse=True)[1]
    # The darts that leave each node, and of each dart the one that goes on.
    order = np.argsort(node, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0])
    out = np.stack([order[begins], order[np.r_[begins[1:], 2 * n] - 1]])[:, node]
    back = (np.arange(2 * n) + n) % (2 * n)
    after = np.where(out[0][back] == back, out[1][back], out[0][back])
    after[after == back] = -1
    chains, place, darts = [], [], []

    def walk(first: np.ndarray) -> np.ndarray:
        """Last darts of the walks from ``first`` on; each dart on the way is noted."""
        at, which, last, k = first, np.arange(len(first)), first.copy(), 0
        while len(at):
            chains.append(which)
            place.append(np.full(len(at), k))
            darts.append(at)
            last[which] = at
            to = after[at]
            on = (to >= 0) & (to != first[which])
            at, which, k = to[on], which[on], k + 1
        return last

    ends = np.flatnonzero(out[0] == out[1])
    last = walk(ends)
    kept = tail[ends] < head[last]
    number = np.where(kept, np.cumsum(kept) - 1, -1)
    open_ = [number[c] for c in chains]
    seen = np.zeros(2 * n, bool)
    if darts:
        seen[np.concatenate(darts)] = True
    # Loops begin at their smallest node, towards its smaller neighbour.
    rest = np.flatnonzero(~seen)
    least, jump = node.copy(), np.where(seen, np.arange(2 * n), after)
    while len(rest):
        lower = np.minimum(least[rest], least[jump[rest]])
        if (lower == least[rest]).all():
            break
        far = jump[jump[rest]]
        least[rest], jump[rest] = lower, far
    first = rest[node[rest] == least[rest]]
    first = first[head[first] < head[np.where(out[0][first] == first, out[1][first], out[0][first])]]
    opened = len(chains)
    walk(first)
    whole = np.concatenate([*open_, *[c + kept.sum() for c in chains[opened:]]])
    heads = np.concatenate([ends[kept], first])
    taken = whole >= 0
    closed = np.arange(len(heads)) >= kept.sum()
    return whole[taken], closed, heads, np.concatenate(place)[taken], np.concatenate(darts)[taken]


def tile_chains(w: int, names: list[str], fields: list[str]):
    """Turns rows (img, level, s) of tiles into their chains' points, and stretches without a line where a chain may go on in
    the next tile."""

    def beyond(node: np.ndarray) -> np.ndarray:
        at = np.where(node % 2 == 0, node // 2 // w, node // 2 % w)
        return (at > 0) & (at % TILE == 0)

    def some(rows: pa.RecordBatch) -> pa.RecordBatch:
        s = rows.column("s").flatten()
        a, b, xa, ya, xb, yb = (s.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "xa", "ya", "xb", "yb"))
        group = np.repeat(np.arange(len(rows)), rows.column("s").value_lengths().to_numpy(zero_copy_only=False))
        chain, closed, first, seq, dart = walked(group, a, b)
        tail, head = np.concatenate([a, b]), np.concatenate([b, a])
        x, y = np.concatenate([xa, xb]), np.concatenate([ya, yb])
        n, back = len(a), (np.arange(2 * len(a)) + len(a)) % (2 * len(a))
        length = np.bincount(chain, minlength=len(first))
        is_last = seq == length[chain] - 1
        last = np.empty(len(first), int)
        last[chain[is_last]] = dart[is_last]
        broken = ~closed & (beyond(tail[first]) | beyond(head[last]))
        # A chain's points are its darts' tails, and the last one's head.
        ok = ~broken[chain]
        ended = np.flatnonzero(~broken)
        points = np.concatenate([dart[ok], back[last[ended]]])
        of = np.concatenate([chain[ok], ended])
        loose = dart[~ok] % n
        none, many = len(loose), len(points)
        null = np.concatenate([np.zeros(many, bool), np.ones(none, bool)])
        whole = lambda p, q: np.concatenate([p, q])
        made = {
            "line": pa.array(whole(tail[first[of]], np.zeros(none, int)), pa.int64(), mask=null),
            "seq": pa.array(whole(np.concatenate([seq[ok], length[ended]]), np.zeros(none, int)), pa.int64(), mask=null),
            "closed": pa.array(whole(closed[of], np.zeros(none, bool)), pa.bool_(), mask=null),
            "xa": pa.array(whole(x[points], xa[loose])),
            "ya": pa.array(whole(y[points], ya[loose])),
            "xb": pa.array(whole(np.zeros(many), xb[loose]), mask=~null),
            "yb": pa.array(whole(np.zeros(many), yb[loose]), mask=~null),
            "a": pa.array(whole(np.zeros(many, int), a[loose]), pa.int64(), mask=~null),
            "b": pa.array(whole(np.zeros(many, int), b[loose]), pa.int64(), mask=~null),
        }
        taken = pa.array(whole(group[points % n], group[loose]))
        return pa.RecordBatch.from_arrays([*[rows.column(c).take(taken) for c in names], *[made[c] for c in fields]], names=[*names, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes = rows.column("s").value_lengths().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // SIDE_BY_SIDE, prepend=0))
            for i, j in zip([0, *cut], [*cut, len(rows)], strict=True):
                if j > i:
                    yield some(rows.slice(i, j - i))

    return run


def lines(raster: DataFrame, levels: list[float], w: int) -> DataFrame:
    """(img, level, line, seq, closed, x, y): the contours of each level as polylines."""
    parts = segments(raster, levels, w)
    tile = lambda c: F.floor(F.col(c) / TILE).alias(f"t{c}")
    tiles = parts.groupBy("img", "level", tile("ix"), tile("iy")).agg(F.collect_list(F.struct("a", "b", "xa", "ya", "xb", "yb")).alias("s")).select("img", "level", "s")
    fields = {"line": "long", "seq": "long", "closed": "boolean", "xa": "double", "ya": "double", "xb": "double", "yb": "double", "a": "long", "b": "long"}
    kinds = dict(tiles.dtypes)
    schema = ", ".join(f"{c} {t}" for c, t in {"img": kinds["img"], "level": kinds["level"], **fields}.items())
    walks = materialise(tiles.mapInArrow(tile_chains(w, ["img", "level"], list(fields)), schema))
    done = walks.where("line is not null").select("img", "level", "line", "seq", "closed", F.col("xa").alias("x"), F.col("ya").alias("y"))
    loose = walks.where("line is null")
    if loose.isEmpty():
        return done
    chained = linked(loose, ["img", "level"])
    ends = [loose.select("img", "level", F.col(c).alias("node"), F.col(f"x{c}").alias("x"), F.col(f"y{c}").alias("y")) for c in "ab"]
    places = ends[0].unionByName(ends[1]).groupBy("img", "level", "node").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return done.unionByName(chained.join(places, ["img", "level", "node"]).select("img", "level", "line", "seq", "closed", "x", "y"))
