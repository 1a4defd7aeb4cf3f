"""Graphs of repositories as two tables, ``nodes`` and ``edges``: building, links, traversal, paths, components, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.functions.text import base_name, clean_path, path_extension, path_prefixes, path_stem
from forgeline.session import materialize, materialize_counted, materialize_observed, read_together

# Relationships with an inverse, and the kinds of nodes that symbols become.
INVERSES = {"IMPORTS": "IMPORTED_BY", "CALLS": "CALLED_BY", "CONTAINS": "DEFINED_IN"}
SYMBOL_NODES = {"class": "class", "interface": "class", "enum": "class", "method": "method"}
MAX_DEPTH, DEPTH_LIMIT = 10, 100


def _id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def distinct_files(chunks: DataFrame) -> DataFrame:
    """``repository_id, file_path`` of each file once, with clean paths; rows without either are left out."""
    return chunks.select("repository_id", clean_path(F.col("file_path")).alias("file_path")).filter(F.col("repository_id").isNotNull() & (F.length("file_path") > 0)).distinct()


def file_nodes(files: DataFrame) -> DataFrame:
    """``node_id, node_type, repository_id, name, file_path`` of repositories, directories and files."""
    repo = F.col("repository_id")
    repositories = files.select("repository_id").distinct().select(_id("repository", repo).alias("node_id"), F.lit("repository").alias("node_type"), "repository_id", repo.cast("string").alias("name"), F.lit(None).cast("string").alias("file_path"))
    dirs = files.select("repository_id", F.explode(path_prefixes(F.col("file_path"))).alias("dir")).distinct()
    directories = dirs.select(_id("directory", repo, F.col("dir")).alias("node_id"), F.lit("directory").alias("node_type"), "repository_id", base_name(F.col("dir")).alias("name"), F.col("dir").alias("file_path"))
    leaves = files.select(_id("file", repo, F.col("file_path")).alias("node_id"), F.lit("file").alias("node_type"), "repository_id", base_name(F.col("file_path")).alias("name"), "file_path")
    return repositories.union(directories).union(leaves)


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """Nodes of ``repository_id, file_path, symbol_type, symbol_name, parent_symbol, start_line``; kinds other than
    classes and methods are functions. ``parent_id`` is the parent symbol of the file, defined last, or else the file."""
    repo, path = F.col("repository_id"), F.col("file_path")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in SYMBOL_NODES.items() for x in kv])[F.col("symbol_type")], F.lit("function"))
    ids = symbols.withColumn("node_id", _id("symbol", repo, path, F.col("symbol_name"), F.coalesce("start_line", F.lit(0)))).withColumn("node_type", kind)
    last = ids.groupBy("repository_id", "file_path", F.col("symbol_name").alias("parent_symbol")).agg(F.max_by("node_id", F.struct(F.coalesce("start_line", F.lit(0)), F.col("node_id"))).alias("found"))
    return ids.join(last, ["repository_id", "file_path", "parent_symbol"], "left").select("node_id", "node_type", "repository_id", F.col("symbol_name").alias("name"), "file_path", F.coalesce("found", _id("file", repo, path)).alias("parent_id"))


def contains_edges(nodes: DataFrame) -> DataFrame:
    """``source, target, relationship`` from directories and repositories to what lies in them directly."""
    inner = nodes.filter(F.col("node_type") != "repository")
    above = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    source = F.when(above == "", _id("repository", F.col("repository_id"))).otherwise(_id("directory", F.col("repository_id"), above))
    return inner.select(source.alias("source"), F.col("node_id").alias("target"), F.lit("CONTAINS").alias("relationship"))


def with_inverses(edges: DataFrame) -> DataFrame:
    """The edges and, for relationships that have one, their inverses; parallel edges stay."""
    opposite = F.create_map(*[F.lit(x) for kv in INVERSES.items() for x in kv])[F.col("relationship")]
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), opposite.alias("relationship")).filter(F.col("relationship").isNotNull())
    return edges.select("source", "target", "relationship").union(back)


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("node_id").distinct()
    lost = lambda end: edges.join(ids, edges[end] == ids["node_id"], "left_anti")
    return lost("source").union(lost("target")).distinct()


def repeated_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_id").count().filter("count > 1")


def file_imports(chunks: DataFrame) -> DataFrame:
    """``repository_id, file_path, import_text`` of the imports at the top level of Python, JavaScript and TypeScript
    files, each once a file."""
    ext = path_extension(F.col("file_path"))
    modules = F.regexp_extract_all("source_code", F.lit(r"(?m)^import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)"), F.lit(1))
    listed = F.transform(F.split(F.array_join(modules, ","), r"[ \t]*,[ \t]*"), lambda m: F.regexp_extract(m, r"^[\w.]*", 0))
    python = F.concat(F.regexp_extract_all("source_code", F.lit(r"(?m)^from[ \t]+([.\w]+)[ \t]+import\b"), F.lit(1)), F.filter(listed, lambda m: m != ""))
    # an import may go over several lines up to its text
    script = F.concat(
        F.regexp_extract_all("source_code", F.lit(r"(?m)^(?:import|export)\b[^'\"`;()=]*['\"]([^'\"\n]+)['\"]"), F.lit(1)),
        F.regexp_extract_all("source_code", F.lit(r"(?m)^(?:const|let|var)\b[^'\"`;()]*=\s*require\(\s*['\"]([^'\"\n]+)['\"]"), F.lit(1)),
    )
    texts = F.when(ext == ".py", python).when(ext.isin(".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), script)
    return chunks.filter(F.col("repository_id").isNotNull()).select("repository_id", clean_path(F.col("file_path")).alias("file_path"), F.explode(texts).alias("import_text")).distinct()


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Each import with ``target_path``, the first file by path of the repository whose path without extension is
    the import or ends with it, or null where it is external. Where ``files`` have an ``ordinal``, as they were
    scanned, the least one is first.

    Dots of an import count as separators. Every ending of every path becomes a row, so the match is a hash join.
    """
    wanted = F.regexp_replace(F.regexp_replace("import_text", r"\.", "/"), "^/+|/+$", "")
    parts = F.split(path_stem(F.col("file_path")), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    place = F.struct(F.col("ordinal") if "ordinal" in files.columns else F.lit(0).alias("ordinal"), "file_path")
    table = files.select("repository_id", place.alias("place"), F.explode(endings).alias("wanted")).groupBy("repository_id", "wanted").agg(F.min("place").getField("file_path").alias("target_path"))
    asked = imports.withColumn("wanted", wanted)
    return asked.join(table, [asked["repository_id"] == table["repository_id"], asked["wanted"] == table["wanted"], asked["wanted"] != ""], "left").select(asked["repository_id"], asked["file_path"], "import_text", "target_path")


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``repository_id, file_path, callee, target``: the symbol of that name in the same file, defined last, or an
    external symbol, one for each name of a repository."""
    last = symbols.groupBy("repository_id", "file_path", F.col("symbol_name").alias("callee")).agg(F.max_by("node_id", F.struct("start_line", "node_id")).alias("found"))
    external = _id("external", F.col("repository_id"), F.lit("external_symbol"), F.col("callee"))
    return calls.join(last, ["repository_id", "file_path", "callee"], "left").select("repository_id", "file_path", "callee", F.coalesce("found", external).alias("target"))


def related(edges: DataFrame, relationships: list[str] | None) -> DataFrame:
    """The edges of the given relationships; null or an empty list is no restriction."""
    return edges.filter(F.col("relationship").isin([r.strip().upper() for r in relationships])) if relationships else edges


def neighbours(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """``node_id, neighbour``, each pair once."""
    a, b = ("target", "source") if incoming else ("source", "target")
    return edges.select(F.col(a).alias("node_id"), F.col(b).alias("neighbour")).distinct()


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, incoming: bool = False) -> DataFrame:
    """``start, node_id, depth``: what each start reaches within ``max_depth`` steps along (or against) the edges,
    each node once at its least depth, without the start itself. ``starts`` has ``node_id``."""
    if not 1 <= max_depth <= DEPTH_LIMIT:
        raise ValueError(f"depth must be 1 to {DEPTH_LIMIT}")
    steps = materialize(neighbours(edges, incoming).filter("node_id <> neighbour"), "steps")
    first = starts.filter(F.col("node_id").isNotNull()).select(F.col("node_id").alias("start"), "node_id", F.lit(0).cast("long").alias("depth")).distinct()
    frontier, n = materialize_counted(first, "reach")
    seen = [frontier]
    for depth in range(1, max_depth + 1):
        if not n:
            break
        step = frontier.join(steps, "node_id").select("start", F.col("neighbour").alias("node_id")).distinct()
        fresh = step.join(read_together(seen).select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier, n = materialize_counted(fresh, "reach")
        seen.append(frontier)
    return read_together(seen).filter("depth > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, relationships: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """``source, target, hops, path`` for the pairs that are connected, within ``max_depth`` steps if that is given; a
    node reaches itself in no step. Nodes found are left out of the next step, so the search ends by itself.

    ``edges`` may have ``ordinal``, the order in which a node's edges are tried (by target without it). Among
    shortest paths the one found first by a breadth-first search in that order wins: it has the least sequence of
    ordinals, so a minimum per node is enough and no level has to be ranked.
    """
    order = F.col("ordinal").cast("string") if "ordinal" in edges.columns else F.col("target")
    order = F.lpad(order, 20, "0") if "ordinal" in edges.columns else order
    steps = materialize(related(edges, relationships).select(F.col("source").alias("at"), F.col("target").alias("to"), order.alias("turn")).groupBy("at", "to").agg(F.min("turn").alias("turn")), "steps")
    wanted = materialize(pairs.select("source", "target").filter("source is not null and target is not null").distinct(), "pairs")
    first = wanted.select("source").distinct().select("source", F.col("source").alias("at"), F.array().cast("array<string>").alias("turns"), F.array("source").alias("path"))
    frontier, n = materialize_counted(first, "front")
    found = [frontier]
    while n and (max_depth is None or len(found) <= max_depth):
        step = frontier.join(steps, "at").select("source", "to", F.concat("turns", F.array("turn")).alias("turns"), F.concat("path", F.array("to")).alias("path"))
        best = step.groupBy("source", F.col("to").alias("at")).agg(F.min(F.struct("turns", "path")).alias("b"))
        fresh = best.join(read_together(found).select("source", "at"), ["source", "at"], "left_anti").select("source", "at", "b.turns", "b.path")
        frontier, n = materialize_counted(fresh, "front")
        found.append(frontier)
    hits = read_together(found).select("source", F.col("at").alias("target"), "path")
    return wanted.join(hits, ["source", "target"]).select("source", "target", (F.size("path") - 1).cast("long").alias("hops"), "path")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node_id, component``: weakly connected components by the least id, by large and small stars in turn.

    Every round sends the neighbours of a node to the least of them; minima are taken map-side, so a node with many
    neighbours is no hot task. Nodes without edges are components of their own.
    """
    known = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).filter("u is not null and v is not null")
    ids = known.select(F.col("u").alias("node_id")).union(known.select("v"))
    if nodes is not None:
        ids = ids.union(nodes.select("node_id").filter("node_id is not null"))
    star = materialize(known.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    before = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), "m").union(low.select("u", "m")).filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()
        star, seen = materialize_observed(small, "star", F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
        if seen == before:
            break
        before = seen
    roots = star.groupBy("u").agg(F.min("v").alias("m"))
    return ids.distinct().join(roots, F.col("node_id") == F.col("u"), "left").select("node_id", F.coalesce("m", "node_id").alias("component"))


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("n_edges"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, isolated nodes and components. All edges count, parallel and inverse ones too."""
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    n = nodes.select("node_id").distinct()
    counted = n.join(ends.withColumn("linked", F.lit(True)), "node_id", "left").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("linked").isNull(), 1)).alias("n_isolated"))
    n_edges = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    parts = connected_components(edges, nodes).agg(F.countDistinct("component").alias("n_components"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return counted.crossJoin(n_edges).crossJoin(parts).select("n_nodes", "n_edges", F.when(F.col("n_nodes") < 2, 0.0).otherwise(F.round(F.col("n_edges") / pairs, 9)).alias("density"), "n_isolated", "n_components")


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids, edges["source"] == ids["node_id"], "left_semi").join(ids, edges["target"] == ids["node_id"], "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, n_out, n_in`` of each node, counted map-side."""
    ends = edges.select(F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    n = ends.groupBy("node_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return nodes.select("node_id").distinct().join(n, "node_id", "left").select("node_id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def highlighted(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """``node_id`` of the selected nodes and of all that are one step away in either direction."""
    s = selected.select("node_id").distinct()
    out = edges.join(s, edges["source"] == s["node_id"]).select(F.col("target").alias("n"))
    back = edges.join(s, edges["target"] == s["node_id"]).select(F.col("source").alias("n"))
    return s.select(F.col("node_id").alias("n")).union(out).union(back).distinct().withColumnRenamed("n", "node_id")


NODE_TYPES = ("repository", "directory", "file", "class", "function", "method", "external_symbol", "external_module")
RELATIONSHIPS = ("CONTAINS", "DEFINED_IN", "IMPORTS", "IMPORTED_BY", "CALLS", "CALLED_BY", "INHERITS")


def nodes_listing(nodes: DataFrame, file_path: str | None = None, symbol_name: str | None = None, node_type: str | None = None) -> DataFrame:
    """Nodes of a file, or else of a name, or else of a type, or else all: the first that is given holds alone."""
    if file_path is not None:
        return nodes.filter(F.col("file_path") == file_path)
    if symbol_name is not None:
        return nodes.filter(F.col("name") == symbol_name)
    if node_type is not None:
        return nodes.filter(F.col("node_type") == _known(node_type.lower(), NODE_TYPES))
    return nodes


def edges_listing(edges: DataFrame, relationship: str | None = None) -> DataFrame:
    """Edges of a relationship, named in any case and with blanks around, or all; an unknown one is an error."""
    return edges if relationship is None else edges.filter(F.col("relationship") == _known(relationship.strip().upper(), RELATIONSHIPS))


def _known(word: str, words: tuple[str, ...]) -> str:
    if word not in words:
        raise ValueError(f"{word!r} is none of {', '.join(words)}")
    return word


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The one node of an id; a missing one is an error."""
    row = nodes.filter(F.col("node_id") == node_id)
    if row.isEmpty():
        raise KeyError(node_id)
    return row


def serialised_nodes(nodes: DataFrame) -> DataFrame:
    """``id, json`` of nodes as they are exchanged; fields that a table lacks are null."""
    fields = ("repository_id", "name", "file_path", "symbol_type", "language", "start_line", "end_line", "parent_node_id", "metadata")
    have = {f: F.col(f) if f in nodes.columns else F.lit(None).cast("string") for f in fields}
    row = F.struct(F.col("node_id").alias("id"), have["repository_id"].alias("repository_id"), F.col("node_type").alias("type"), *[have[f].alias(f) for f in fields[1:]])
    return nodes.select(F.col("node_id").alias("id"), F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def serialised_edges(edges: DataFrame) -> DataFrame:
    """``source, target, json`` of edges as they are exchanged, with weight 1 where they have none."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    row = F.struct("source", "target", "relationship", weight.alias("weight"))
    return edges.select("source", "target", F.to_json(row).alias("json"))


def graph_health(nodes: DataFrame, edges: DataFrame, repositories: DataFrame) -> DataFrame:
    """``repository_id, available, n_nodes, n_edges`` of each repository; an edge counts where its source lies."""
    owner = nodes.select("node_id", F.col("repository_id").cast("string").alias("repository_id"))
    n = owner.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.join(owner, edges["source"] == owner["node_id"]).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_edges"))
    asked = repositories.select(F.col("id").cast("string").alias("repository_id")).filter("repository_id is not null").distinct()
    return asked.join(n, "repository_id", "left").join(e, "repository_id", "left").select("repository_id", F.col("n_nodes").isNotNull().alias("available"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def external_nodes(names: DataFrame, node_type: str) -> DataFrame:
    """One node for each ``repository_id, name`` outside of the repository, of type external_symbol or external_module."""
    repo = F.col("repository_id")
    once = names.filter("repository_id is not null and name is not null").select("repository_id", "name").distinct()
    return once.select(_id("external", repo, F.lit(node_type), F.col("name")).alias("node_id"), F.lit(node_type).alias("node_type"), "repository_id", "name", F.lit(None).cast("string").alias("file_path"))


def full_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all passes: repositories, directories, files and symbols with what contains them, imports,
    calls and base classes, each with its inverse, and the external nodes they need.

    ``symbols`` has ``repository_id, file_path, symbol_type, symbol_name, parent_symbol, start_line``; ``imports``
    ``repository_id, file_path, import_text``; ``calls`` and ``bases`` ``repository_id, file_path, symbol_name`` with
    ``callee`` or ``base``. A symbol's links start at its last definition in the file. An import leads to a file of
    the repository or to an external module, a call to a symbol of the same file or to an external one, and a base
    class always to an external one. A pair is linked as often as it is stated.
    """
    tree, found = file_nodes(files), symbol_nodes(symbols)
    last = symbols.groupBy("repository_id", "file_path", "symbol_name").agg(F.max(F.coalesce("start_line", F.lit(0))).alias("line"))
    defined = last.withColumn("node_id", _id("symbol", F.col("repository_id"), F.col("file_path"), F.col("symbol_name"), F.col("line")))
    place = ["repository_id", "file_path", "symbol_name"]
    outer = lambda kind, name: _id("external", F.col("repository_id"), F.lit(kind), F.col(name))
    file_id = lambda path: _id("file", F.col("repository_id"), F.col(path))

    resolved = resolve_imports(files, imports)
    import_edges = resolved.select(file_id("file_path").alias("source"), F.when(F.col("target_path").isNotNull(), file_id("target_path")).otherwise(outer("external_module", "import_text")).alias("target"), F.lit("IMPORTS").alias("relationship"))
    targets = defined.select("repository_id", "file_path", F.col("symbol_name").alias("callee"), F.col("node_id").alias("found"))
    called = calls.join(defined, place).join(targets, ["repository_id", "file_path", "callee"], "left")
    call_edges = called.select(F.col("node_id").alias("source"), F.coalesce("found", outer("external_symbol", "callee")).alias("target"), F.lit("CALLS").alias("relationship"))
    heirs = bases.join(defined, place)
    base_edges = heirs.select(F.col("node_id").alias("source"), outer("external_symbol", "base").alias("target"), F.lit("INHERITS").alias("relationship"))

    outside = external_nodes(called.filter("found is null").select("repository_id", F.col("callee").alias("name")).union(heirs.select("repository_id", "base")), "external_symbol")
    modules = external_nodes(resolved.filter("target_path is null").select("repository_id", F.col("import_text").alias("name")), "external_module")
    inner = found.select("node_id", "node_type", "repository_id", "name", "file_path").distinct()
    nodes = tree.union(inner).union(outside).union(modules)
    within = found.select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.lit("CONTAINS").alias("relationship")).distinct()
    return nodes, with_inverses(contains_edges(tree).union(within).union(import_edges).union(call_edges).union(base_edges))
