"""Hierarchies against plain walks over small random graphs."""

import random

from forgeline.operators.hierarchy import descendants, resolve_hierarchy

SCHEMA = "node_id string, parent_node_id string, name string, id string, up string, anc int"


def brute(parents, names):
    kids, out = {}, {}
    up = {n: p if p in parents else None for n, p in parents.items()}
    for n in up:
        seen, x = [], n
        while up[x] is not None and up[x] not in seen:
            seen.append(up[x])
            x = up[x]
        for a in set(seen) - {n}:
            kids.setdefault(a, set()).add(n)
        if up[x] is None:
            way = [n, *seen][::-1]
            out[n] = (way[0], len(seen), " > ".join(names[w] for w in way), "tree")
        else:
            out[n] = ("", -1, "", "on_cycle" if n in seen else "below_cycle")
    return {n: (*v[:3], len(kids.get(n, ())), v[3]) for n, v in out.items()}, {(a, n) for a, k in kids.items() for n in k}


def as_dict(df):
    return {r.node_id: (r.root_node_id, r.depth, r.node_path, r.n_descendants, r.state) for r in df.collect()}


def test_random_graphs_match_plain_walks(spark):
    rng = random.Random(7)
    n = 60
    parents = {f"n{i}": rng.choice([None, "", "gone", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", f"n{max(0, i - 1)}"]) for i in range(n)}
    parents |= {f"deep{i}": f"deep{i - 1}" if i else None for i in range(40)}
    parents["self"] = "self"
    names = {k: k.upper() for k in parents}
    rows = [(k, v, names[k], "x", "y", 1) for k, v in parents.items()]
    df = spark.createDataFrame(rows + rows[:9], SCHEMA)
    want, pairs = brute(parents, names)
    assert as_dict(resolve_hierarchy(df)) == want
    assert {(r.ancestor_id, r.node_id) for r in descendants(df).collect()} == pairs


def test_nulls_empty_names_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a", "lost", None, None, None), ("a", None, None, None, None, None), ("b", "a", "B" * 5000, None, None, None)], SCHEMA)
    assert as_dict(resolve_hierarchy(df)) == {"a": ("a", 0, "", 1, "tree"), "b": ("a", 1, " > " + "B" * 5000, 0, "tree")}
    assert resolve_hierarchy(df.limit(0)).count() == 0
    assert descendants(df.limit(0)).count() == 0


def test_one_circle_without_roots(spark):
    df = spark.createDataFrame([("a", "b", "A", "", "", 0), ("b", "a", "B", "", "", 0), ("c", "a", "C", "", "", 0)], SCHEMA)
    assert as_dict(resolve_hierarchy(df)) == {"a": ("", -1, "", 2, "on_cycle"), "b": ("", -1, "", 2, "on_cycle"), "c": ("", -1, "", 0, "below_cycle")}
