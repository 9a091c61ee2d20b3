"""Clusterings against a sequential version that merges one edge at a time."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest

from somatrix.operators import clustering, hierarchy, neighbors


def condensed_labels(ids: np.ndarray, edges: pd.DataFrame, least: int, allow_single: bool) -> np.ndarray:
    """Cluster of each id, -1 for noise: single-linkage merges over the spanning edges, splits into parts smaller than
    ``least`` taken as points that fall out, and of nested clusters those of most excess of mass."""
    n = len(ids)
    place = {x: i for i, x in enumerate(ids)}
    order = edges.sort_values(["w", "src", "dst"])
    root, top = list(range(2 * n)), list(range(n))
    children: dict[int, tuple[int, int, float]] = {}
    size = [1] * n

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, w in zip(order["src"], order["dst"], order["w"], strict=True):
        x, y = find(place[a]), find(place[b])
        if x != y:
            new = len(size)
            size.append(size[x] + size[y])
            if new >= len(root):
                root.append(new)
            root[x] = root[y] = new
            children[new] = (x, y, w)
    tops = sorted({find(i) for i in range(n)})
    if len(tops) > 1:  # a forest: what isn't connected parts at infinite distance
        joined = tops[0]
        for t in tops[1:]:
            new = len(size)
            size.append(size[joined] + size[t])
            children[new] = (joined, t, np.inf)
            joined = new
        tops = [joined]

    labels, stability, parent, born, members = np.full(n, -1), {0: 0.0}, {0: -1}, {0: 0.0}, {0: []}
    if not n:
        return labels

    def leaves(node: int) -> Iterator[int]:
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                yield x
            else:
                stack += children[x][:2]

    stack, n_clusters = [(tops[0], 0)], 1
    while stack:
        node, cluster = stack.pop()
        if node < n:
            members[cluster].append(node)
            continue
        a, b, w = children[node]
        at = 1 / w if w > 0 else 1e12
        big = [x for x in (a, b) if size[x] >= least]
        gone = size[node] if len(big) == 2 else sum(size[x] for x in (a, b) if x not in big)
        stability[cluster] += gone * max(0.0, at - born[cluster])
        for x in (a, b):
            if x not in big:
                members[cluster] += list(leaves(x))
        if len(big) == 2:
            for x in big:
                parent[n_clusters], born[n_clusters], stability[n_clusters], members[n_clusters] = cluster, at, 0.0, []
                stack.append((x, n_clusters))
                n_clusters += 1
        elif big:
            stack.append((big[0], cluster))
    below: dict[int, list[int]] = {}
    for c, p in parent.items():
        below.setdefault(p, []).append(c)
    chosen = dict.fromkeys(range(n_clusters), False)
    best = dict(stability)
    for c in reversed(range(n_clusters)):
        own = sum(best[x] for x in below.get(c, []))
        if (c or allow_single) and (stability[c] >= own or not below.get(c)):
            chosen[c] = True
        else:
            best[c] = own
    number, stack = 0, [0]
    while stack:
        c = stack.pop()
        if chosen[c]:
            inside = [c]
            for x in inside:
                inside += below.get(x, [])
            for x in inside:
                labels[members[x]] = number
            number += 1
        else:
            stack += sorted(below.get(c, []), reverse=True)
    return labels


def canonical(ids, labels):
    """Clusters numbered by their least ids."""
    seen = {}
    return {int(i): -1 if x < 0 else seen.setdefault(x, len(seen)) for i, x in sorted(zip(ids, labels, strict=True))}


def brute_tree(x, samples):
    """Prim's spanning tree of mutual reachability over all pairs, and its weight."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.maximum(np.maximum(d, core), core[:, None])
    best, inside, weight = reach[0].copy(), {0}, 0.0
    while len(inside) < len(x):
        best[list(inside)] = np.inf
        new = int(best.argmin())
        weight += best[new]
        inside.add(new)
        best = np.minimum(best, reach[new])
    return weight


def known_sets():
    rng = np.random.default_rng(5)
    blobs = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    ring = np.array([(8 * np.cos(t), 8 * np.sin(t)) for t in np.linspace(0, 6.28, 90)]) + rng.normal(0, 0.15, (90, 2))
    rings = np.vstack([ring, rng.normal(0, 0.5, (40, 2))])
    nested = np.vstack([rng.normal((0, 0), 0.2, (25, 2)), rng.normal((2, 0), 0.2, (25, 2)), rng.normal((30, 0), 1.5, (40, 2)), rng.uniform(-20, 50, (20, 2))])
    return {"blobs": (blobs, 3), "rings": (rings, 2), "nested": (nested, None)}


@pytest.mark.parametrize("name", sorted(known_sets()))
def test_hdbscan_equals_sequential(spark, name):
    """Three sets with known clusters: the tree weighs what that of all pairs does, though neighbours leave parts apart, and
    the labels are those of merging one edge at a time."""
    x, clusters = known_sets()[name]
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    near = neighbors.knn(points, 10)
    tree = neighbors.spanning_tree(points, near, 5).toPandas()
    assert len(tree) == len(x) - 1
    if name != "nested":  # there the graph of neighbours isn't the whole one
        assert tree["w"].sum() == pytest.approx(brute_tree(x, 5))
    ids = np.arange(len(x))
    found = hierarchy.labels(points.select("id"), spark.createDataFrame(tree), 10).toPandas()
    expected = canonical(ids, condensed_labels(ids, tree, 10, True))
    assert dict(zip(found["id"], found["cluster"], strict=True)) == expected
    if clusters:
        assert len(set(expected.values()) - {-1}) == clusters


@pytest.mark.parametrize(("shape", "least", "single"), [("path", 2, False), ("star", 4, True), ("random", 3, True), ("random", 6, False), ("levels", 4, False)])
def test_hierarchy_of_trees(spark, shape, least, single):
    """Trees with equal weights, zero weights, long chains of rising weights and one point with most edges."""
    rng, n = np.random.default_rng(7), 90
    if shape == "path":
        edges = [(i, i + 1, float(i % 7 == 0) + i / 10) for i in range(n - 1)]
    elif shape == "star":
        edges = [(0, i, float(i % 9)) for i in range(1, n)]
    elif shape == "levels":  # clusters inside clusters
        edges = [(i - 1, i, float([k for k in (1, 5, 15, 45) if i % k == 0][-1])) for i in range(1, n)]
    else:
        edges = [(int(rng.integers(0, i)), i, float(rng.integers(0, 12))) for i in range(1, n)]
    tree = pd.DataFrame(edges, columns=["src", "dst", "w"])
    found = hierarchy.labels(spark.range(n), spark.createDataFrame(tree), least, single).toPandas()
    assert dict(zip(found["id"], found["cluster"], strict=True)) == canonical(np.arange(n), condensed_labels(np.arange(n), tree, least, single))


def test_few_points(spark):
    def run(rows, least=3):
        df = spark.createDataFrame(rows, "id long, vec array<double>")
        return {r["id"]: r["cluster"] for r in clustering.hdbscan(df, least, 2).collect()}

    assert run([]) == {}
    assert run([(1, [0.0])]) == {1: -1}
    assert run([(i, [0.0, 0.0]) for i in range(4)]) == dict.fromkeys(range(4), 0)
    with pytest.raises(ValueError, match="two points"):
        hierarchy.labels(spark.range(3), spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double"), 1)
