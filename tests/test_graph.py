"""Graph operators against plain searches over small random graphs."""

import random
from collections import deque

import pytest

from forgeline.operators import graph

EDGE = "source string, target string, relationship string, ordinal int"


def make(seed, n=24, m=40):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)]
    return nodes, [(rng.choice(nodes), rng.choice(nodes), rng.choice(["CALLS", "IMPORTS", "CONTAINS"]), i) for i in range(m)]


def bfs(edges, start):
    out = {}
    for s, t, _, i in sorted(edges, key=lambda e: e[3]):
        out.setdefault(s, []).append(t)
    paths, queue = {start: [start]}, deque([start])
    while queue:
        x = queue.popleft()
        for y in out.get(x, ()):
            if y not in paths:
                paths[y] = paths[x] + [y]
                queue.append(y)
    return paths


def test_shortest_paths_follow_the_order_of_a_queue(spark):
    nodes, edges = make(3)
    pairs = spark.createDataFrame([(a, b) for a in nodes[:4] for b in nodes] + [(None, "n1"), ("gone", "n1")], "source string, target string")
    got = {(r.source, r.target): r.path for r in graph.shortest_paths(spark.createDataFrame(edges, EDGE), pairs).collect()}
    want = {(a, b): p for a in nodes[:4] for b, p in bfs(edges, a).items()}
    assert got == want


def test_paths_longer_than_the_depth_limit(spark):
    n = graph.DEPTH_LIMIT + 2
    e = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "CONTAINS", 0) for i in range(n)] + [(f"c{n}", "c0", "CONTAINS", 0)], EDGE).coalesce(1)
    pairs = spark.createDataFrame([("c0", f"c{n}"), ("c0", "c3"), ("c0", "gone")], "source string, target string")
    assert {r.target: (r.hops, r.path) for r in graph.shortest_paths(e, pairs).collect()} == {t: (k, [f"c{i}" for i in range(k + 1)]) for t, k in (("c3", 3), (f"c{n}", n))}
    assert [(r.target, r.hops) for r in graph.shortest_paths(e, pairs, max_depth=3).collect()] == [("c3", 3)]


def test_paths_by_relationship(spark):
    e = spark.createDataFrame([("a", "b", "CALLS", 0), ("b", "c", "IMPORTS", 1), ("a", "c", "CONTAINS", 2)], EDGE)
    pairs = spark.createDataFrame([("a", "c")], "source string, target string")
    assert [r.hops for r in graph.shortest_paths(e, pairs, ["calls", " imports "]).collect()] == [2]
    assert graph.shortest_paths(e, pairs, ["CALLS"]).count() == 0
    assert [r.hops for r in graph.shortest_paths(e, pairs, []).collect()] == [1]


def test_reachable_both_ways(spark):
    nodes, edges = make(5)
    df = spark.createDataFrame(edges, EDGE)
    starts = spark.createDataFrame([(x,) for x in nodes[:3]] + [(None,)], "node_id string")
    for incoming in (False, True):
        use = [(t, s, r, i) for s, t, r, i in edges] if incoming else edges
        got = {(r.start, r.node_id): r.depth for r in graph.reachable(df, starts, 2, incoming).collect()}
        want = {(a, b): len(p) - 1 for a in nodes[:3] for b, p in bfs(use, a).items() if 1 <= len(p) - 1 <= 2}
        assert got == want
    with pytest.raises(ValueError):
        graph.reachable(df, starts, 0)


def test_components(spark):
    nodes, edges = make(8, 40, 22)
    near = {x: {x} for x in nodes}
    for s, t, *_ in edges:
        near[s].add(t)
        near[t].add(s)
    want = {}
    for x in nodes:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        want[x] = min(seen)
    got = graph.connected_components(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in nodes], "node_id string"))
    assert {r.node_id: r.component for r in got.collect()} == want
    assert graph.connected_components(spark.createDataFrame([], EDGE)).count() == 0
    chain = spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}", "CALLS", 0) for i in range(200)], EDGE)
    assert {r.component for r in graph.connected_components(chain).collect()} == {"c000"}


def test_imports_take_the_first_file_that_ends_with_them(spark):
    files = spark.createDataFrame([(1, "src/utils.py"), (1, "lib/utils.ts"), (1, "a/b/c.py"), (2, "utils.py")], "repository_id long, file_path string")
    imports = spark.createDataFrame([(1, "x.ts", "./utils"), (1, "y.py", "b.c"), (1, "y.py", "..."), (1, "y.py", "missing"), (2, "z.py", "utils")], "repository_id long, file_path string, import_text string")
    got = {(r.repository_id, r.import_text): r.target_path for r in graph.resolve_imports(files, imports).collect()}
    assert got == {(1, "./utils"): "lib/utils.ts", (1, "b.c"): "a/b/c.py", (1, "..."): None, (1, "missing"): None, (2, "utils"): "utils.py"}


def test_edges_checks_and_symbols(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", "CONTAINS", 0), ("a", "x", "INHERITS", 1)], EDGE)
    assert graph.dangling_edges(nodes, edges).count() == 1
    assert [r.node_id for r in graph.repeated_nodes(nodes).collect()] == ["b"]
    assert sorted((r.source, r.target, r.relationship) for r in graph.with_inverses(edges).collect()) == [("a", "b", "CONTAINS"), ("a", "x", "INHERITS"), ("b", "a", "DEFINED_IN")]
    symbols = spark.createDataFrame([(1, "f.py", "class", "C", None, 1), (1, "f.py", "class", "C", None, 9), (1, "f.py", "method", "m", "C", 10), (1, "f.py", "enum", "E", "gone", None)], "repository_id long, file_path string, symbol_type string, symbol_name string, parent_symbol string, start_line int")
    got = {r.node_id: (r.node_type, r.parent_id) for r in graph.symbol_nodes(symbols).collect()}
    assert got == {"symbol:1:f.py:C:1": ("class", "file:1:f.py"), "symbol:1:f.py:C:9": ("class", "file:1:f.py"), "symbol:1:f.py:m:10": ("method", "symbol:1:f.py:C:9"), "symbol:1:f.py:E:0": ("class", "file:1:f.py")}
    one = graph.graph_statistics(spark.createDataFrame([("a",)], "node_id string"), spark.createDataFrame([], EDGE)).first()
    assert (one.n_nodes, one.density, one.n_isolated, one.n_components) == (1, 0.0, 1, 1)


def test_listings_and_lookups(spark):
    nodes = spark.createDataFrame([("a", "file", "r", "x", "p"), ("b", "class", "r", "y", "p")], "node_id string, node_type string, repository_id string, name string, file_path string")
    edges = spark.createDataFrame([("a", "b", "CONTAINS")], "source string, target string, relationship string")
    assert graph.nodes_listing(nodes, None, "y", "file").count() == 1 and graph.nodes_listing(nodes).count() == 2
    assert graph.edges_listing(edges, " contains ").count() == 1 and graph.node(nodes, "a").count() == 1
    for wrong in (lambda: graph.nodes_listing(nodes, None, None, "thing"), lambda: graph.edges_listing(edges, "LIKES")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        graph.node(nodes, "z")


def test_imports_over_several_lines(spark):
    source = "import {\n  a,\n  b,\n} from './lib/x';\nimport './side';\nexport * from './y';\nconst z = require('z');\n"
    rows = [(1, "src/m.ts", source), (1, "n.py", "import os, sys as s\nfrom a.b import (\n c)\n"), (1, "e.py", None)]
    got = {(r.file_path, r.import_text) for r in graph.file_imports(spark.createDataFrame(rows, "repository_id long, file_path string, source_code string")).collect()}
    assert got == {("src/m.ts", t) for t in ("./lib/x", "./side", "./y", "z")} | {("n.py", t) for t in ("os", "sys", "a.b")}
    files = spark.createDataFrame([(1, "b/u.py", 0), (1, "a/u.py", 1)], "repository_id long, file_path string, ordinal long")
    asked = spark.createDataFrame([(1, "n.py", "u")], "repository_id long, file_path string, import_text string")
    assert graph.resolve_imports(files, asked).first()["target_path"] == "b/u.py"
