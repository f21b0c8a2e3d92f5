"""Heavy paths against a plain walk of the tree."""

import random
from collections import defaultdict

import pytest

from plumbline.operators import iterative, trees


def plain(edges):
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    seen, out = set(), {}
    for root in sorted(near):
        if root in seen:
            continue
        order, parent = [root], {root: None}
        for a in order:
            for b in near[a]:
                if b not in parent:
                    parent[b] = a
                    order.append(b)
        seen |= set(order)
        height = defaultdict(float)
        for a in reversed(order):
            if parent[a] is not None:
                height[parent[a]] = max(height[parent[a]], height[a] + near[a][parent[a]])
        kids = {a: sorted((b for b in near[a] if parent[b] == a), key=lambda b: (-height[b], b)) for a in order}
        for head in [root, *(b for a in order for b in kids[a][1:])]:
            path = [] if parent[head] is None else [parent[head]]
            at = head
            while at is not None:
                path.append(at)
                at = kids[at][0] if kids[at] else None
            out[head] = path
    return out


def forest(kind, rng):
    if kind == "chain":
        nodes = rng.sample(range(1000), 150)
        pairs = list(zip(nodes, nodes[1:]))
    elif kind == "star":
        pairs = [(50, i) for i in range(60) if i != 50]
    else:
        nodes = rng.sample(range(5000), 240)
        pairs = [(nodes[i], nodes[rng.randrange(max(0, i - 9), i)]) for i in range(1, 240) if i % 60]
    return [(*rng.sample(p, 2), float(rng.randint(1, 900))) for p in pairs]


@pytest.mark.parametrize("kind", ["chain", "star", "trees"])
def test_heavy_paths_are_the_plain_ones(spark, kind):
    edges = forest(kind, random.Random(6))
    got = defaultdict(list)
    for r in trees.heavy_paths(spark.createDataFrame(edges, "a long, b long, len double")).collect():
        got[r["path"]].append((r["seq"], r["node"]))
    paths = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert paths == plain(edges)
    drawn = sorted(tuple(sorted(p)) for path in paths.values() for p in zip(path, path[1:]))
    assert drawn == sorted(tuple(sorted(e[:2])) for e in edges)  # each edge once


def test_no_edges_no_paths(spark):
    assert trees.heavy_paths(spark.createDataFrame([], "a long, b long, len double")).count() == 0


def test_ways_up_end_at_roots_and_a_forest_names_trees_by_them(spark, monkeypatch):
    """A tree's own lightest edges lead to its root, so that no components are searched."""
    way = spark.createDataFrame([(0, 0), (7, 7), *[(k, k - 1) for k in (1, 2, 3, 4, 5, 6, 8)]], "node long, top long")
    assert {r["node"]: r["top"] for r in iterative.topmost(way).collect()} == {k: 0 if k < 7 else 7 for k in range(9)}
    monkeypatch.setattr(iterative, "components", lambda links: pytest.fail("components"))
    ring = [(k, (k + 1) % 12, float(k * 5 % 12)) for k in range(12)] + [(20, 21, 1.0), (21, 22, 1.0), (20, 22, 1.0)]
    got = iterative.forest(spark.createDataFrame(ring, "a long, b long, w double")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted((min(a, b), max(a, b)) for a, b, w in ring if w < 11 and (a, b) != (21, 22))
