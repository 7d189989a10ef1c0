import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators import hierarchy


def brute(edges):
    out, parents = defaultdict(set), defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            out[a].add(b)
            if a != b:
                parents[b].add(a)
    rows = set()
    for r in [a for a in out if not parents[a]]:
        depth, queue = {r: 0}, [r]
        for u in queue:
            for w in sorted(out[u]):
                if w not in depth:
                    depth[w] = depth[u] + 1
                    queue.append(w)
        rows |= {(n, r, d) for n, d in depth.items()}
    for n in list(out):
        seen, todo = set(), list(out[n])
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += out.get(u, ())
        if n in seen:
            rows.add((n, "", -1))
    return rows


def graph(kind):
    rnd = random.Random(kind)
    if kind == "chain":
        return [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n20", "n10"), ("n3", "n30"), ("x", "n39")]
    if kind == "small":
        return [("a", "b"), ("a", "b"), ("b", "c"), ("c", "b"), ("s", "s"), ("s", "t"), (None, "a"), ("a", None), ("p", "q"), ("q", "p"), ("r", "q")]
    n = 60
    return [(f"n{rnd.randrange(n)}", f"n{min(n - 1, rnd.randrange(n) + rnd.randrange(6))}") for _ in range(80)] + [(f"r{i}", "hub") for i in range(30)] + [("hub", "n1")]


@pytest.mark.parametrize("in_memory", [1_000_000, 0])
def test_against_brute_force(frame, monkeypatch, in_memory):
    """A long chain with back links, a small graph with loops, nulls and repeated links, and a random one with a hub;
    remainders finished by one task, and by further rounds."""
    monkeypatch.setattr(hierarchy, "IN_MEMORY", in_memory)
    name = lambda kind, x: x and f"{kind}/{x}"
    edges = [(name(k, a), name(k, b)) for k in ("chain", "small", "mixed")[not in_memory :] for a, b in graph(k)]
    got = hierarchy.hierarchy(frame([(a, b, 1) for a, b in edges], "from_path string, to_path string, path int")).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(edges)


def test_long_chain_in_segments(frame, spark, monkeypatch):
    """A chain of many segments with a link back near its end, and chains of other roots that enter it."""
    monkeypatch.setattr(hierarchy, "SEGMENT", 512)
    n = 5000
    edges = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [("n4800", "n4700"), ("x", "n2500")]
    got = {(r.path, r.root_path): r.depth for r in hierarchy.hierarchy(frame(edges, "from_path string, to_path string")).collect()}
    want = {(f"n{i}", "n0"): i for i in range(n + 1)} | {(f"n{i}", "x"): i - 2499 for i in range(2500, n + 1)} | {("x", "x"): 0} | {(f"n{i}", ""): -1 for i in range(4700, 4801)}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 12).flatmap(lambda n: st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), min_size=1, max_size=30)))
def test_remainders_of_one_task(pairs):
    u, v = (np.array(x) * 7 for x in zip(*pairs))
    n = 12
    reach = np.eye(n, dtype=bool)
    reach[u // 7, v // 7] = True
    for k in range(n):
        reach |= np.outer(reach[:, k], reach[k])
    both = reach & reach.T
    got = hierarchy._components_of(u, v)
    named = dict(zip(got["id"].tolist(), got["component"].tolist()))
    assert set(named) == {i * 7 for i in range(n) if both[i].sum() > 1}
    assert all((named[i] == named[j]) == bool(both[i // 7, j // 7]) for i in named for j in named)
    up = {int(a): int(b) for a, b in zip(u, v) if a != b}
    while any(b not in up for b in up.values()):
        up = {a: b for a, b in up.items() if b in up}
    if up:
        f = hierarchy._forest_of(np.array(list(up)), np.array(list(up.values())))
        parent = dict(zip(f["id"].tolist(), f["parent"].to_pylist()))
        assert set(parent) == set(up) and all(p in (None, up[i]) for i, p in parent.items())
        above = {i: [i] for i in parent}
        for i, path in above.items():
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
                assert len(path) <= len(up)
        for i, d, r, size in zip(f["id"].tolist(), f["depth"], f["root"], f["size"]):
            assert d == len(above[i]) - 1 and r == above[i][-1] and size == sum(i in path for path in above.values())


def test_empty(frame):
    assert hierarchy.hierarchy(frame([], "from_path string, to_path string")).collect() == []


def test_long_chain_in_segments(frame, spark, monkeypatch):
    """A chain of many segments with a link back near its end, and chains of other roots that enter it."""
    monkeypatch.setattr(hierarchy, "SEGMENT", 512)
    n = 5000
    edges = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [("n4800", "n4700"), ("x", "n2500")]
    got = {(r.path, r.root_path): r.depth for r in hierarchy.hierarchy(frame(edges, "from_path string, to_path string")).collect()}
    want = {(f"n{i}", "n0"): i for i in range(n + 1)} | {(f"n{i}", "x"): i - 2499 for i in range(2500, n + 1)} | {("x", "x"): 0} | {(f"n{i}", ""): -1 for i in range(4700, 4801)}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 12).flatmap(lambda n: st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), min_size=1, max_size=30)))
def test_remainders_of_one_task(pairs):
    u, v = (np.array(x) * 7 for x in zip(*pairs))
    n = 12
    reach = np.eye(n, dtype=bool)
    reach[u // 7, v // 7] = True
    for k in range(n):
        reach |= np.outer(reach[:, k], reach[k])
    both = reach & reach.T
    got = hierarchy._components_of(u, v)
    named = dict(zip(got["id"].tolist(), got["component"].tolist()))
    assert set(named) == {i * 7 for i in range(n) if both[i].sum() > 1}
    assert all((named[i] == named[j]) == bool(both[i // 7, j // 7]) for i in named for j in named)
    up = {int(a): int(b) for a, b in zip(u, v) if a != b}
    while any(b not in up for b in up.values()):
        up = {a: b for a, b in up.items() if b in up}
    if up:
        f = hierarchy._forest_of(np.array(list(up)), np.array(list(up.values())))
        parent = dict(zip(f["id"].tolist(), f["parent"].to_pylist()))
        assert set(parent) == set(up) and all(p in (None, up[i]) for i, p in parent.items())
        above = {i: [i] for i in parent}
        for i, path in above.items():
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
                assert len(path) <= len(up)
        for i, d, r, size in zip(f["id"].tolist(), f["depth"], f["root"], f["size"]):
            assert d == len(above[i]) - 1 and r == above[i][-1] and size == sum(i in path for path in above.values())


def test_empty(frame):
    assert hierarchy.hierarchy(frame([], "from_path string, to_path string")).collect() == []


def test_tree_paths_and_intervals(frame):
    """A small tree, a cycle, and a diamond, in which every importer keeps what it shares with others."""
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("d", "e"), ("x", "y"), ("y", "x")]
    diamond = [("R", "A"), ("R", "B"), ("A", "C"), ("B", "C"), ("C", "D"), ("Q", "B")]
    t = hierarchy.tree(frame(edges + diamond, "from_path string, to_path string")).cache()
    pairs = {tuple(r) for r in hierarchy.descendants(t).collect()}
    assert [{b for a, b in pairs if a == x} for x in "ABQ"] == [{"C", "D"}, {"C", "D"}, {"B", "C", "D"}]
    rows = {r.path: r for r in t.collect()}
    assert [x.root_path for x in rows["D"].roots] == ["Q", "R"]
    assert rows["e"].full_path == "r > a > d > e" and rows["e"].depth == 3 and rows["e"].root_path == "r"
    below = lambda p: {q for q, r in rows.items() if r.root_path == rows[p].root_path and rows[p].pre < r.pre <= rows[p].last}
    assert below("r") == {"a", "b", "c", "d", "e"} and below("a") == {"c", "d", "e"} and below("e") == set()
    assert {p for p, r in rows.items() if r.is_circular} == {"x", "y"}


def test_tree_gives_every_descendant_root_and_the_fewest_links(frame):
    """Nodes with several parents, cycles with and without a root, loops, a hub, a small tree, a cycle and a diamond."""
    name = lambda kind, x: x and f"{kind}/{x}"
    edges = [(name(k, a), name(k, b)) for k in ("chain", "small", "mixed") for a, b in graph(k)]
    edges += [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("R", "A"), ("R", "B"), ("A", "C"), ("B", "C"), ("C", "D"), ("Q", "B")]
    out = defaultdict(set)
    for a, b in edges:
        if a and b:
            out[a].add(b)
    nodes = {x for e in edges if all(e) for x in e}
    reach = {}
    for a in nodes:
        reach[a], todo = set(), list(out[a])
        while todo:
            u = todo.pop()
            if u not in reach[a]:
                reach[a].add(u)
                todo += out[u]
    roots = defaultdict(set)
    for n, r, d in brute(edges):
        if r:
            roots[n].add((r, d))
    t = hierarchy.tree(frame(edges, "from_path string, to_path string")).cache()
    rows = {r.path: r for r in t.collect()}
    assert set(rows) == nodes
    pairs = [tuple(r) for r in hierarchy.descendants(t).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in nodes for b in reach[a] - {a}}
    for n, r in rows.items():
        assert {tuple(x) for x in r.roots} == roots[n] and r.n_descendants == len(reach[n] - {n})
        steps = r.full_path.split(" > ")
        assert len(steps) == r.depth + 1 and steps[0] == r.root_path and steps[-1] == n and all(b in out[a] for a, b in zip(steps, steps[1:]))
        assert r.is_circular == (n in reach[n])
        if roots[n]:
            assert r.depth == min(d for _, d in roots[n]) and (r.root_path, r.depth) in roots[n]
    # A node's own subtree in the forest of the full paths is an interval; a shared file is below each of its importers.
    assert rows["e"].full_path == "r > a > d > e" and rows["e"].depth == 3 and rows["e"].root_path == "r"
    below = lambda p: {q for q, r in rows.items() if r.root_path == rows[p].root_path and rows[p].pre < r.pre <= rows[p].last}
    assert below("r") == {"a", "b", "c", "d", "e"} and below("a") == {"c", "d", "e"} and below("e") == set()
    assert [{b for a, b in pairs if a == x} for x in "ABQ"] == [{"C", "D"}, {"C", "D"}, {"B", "C", "D"}] and [x.root_path for x in rows["D"].roots] == ["Q", "R"]
