"""Queries of code graphs, over code_chunks (built here) and graph_nodes (given)."""

from pyspark.sql import functions as F

from forgeline.operators import graph
from forgeline.session import materialize, table


def _built(spark, sf_dir):
    return graph.file_nodes(graph.distinct_files(table(spark, sf_dir, "code_chunks")))


def graph_file_nodes(spark, sf_dir):
    return _built(spark, sf_dir)


def graph_file_edges(spark, sf_dir):
    return graph.with_inverses(graph.contains_edges(_built(spark, sf_dir)))


def graph_relationships(spark, sf_dir):
    return graph.relationship_counts(graph_file_edges(spark, sf_dir))


def graph_imports(spark, sf_dir):
    chunks = table(spark, sf_dir, "code_chunks")
    return graph.resolve_imports(graph.distinct_files(chunks), graph.file_imports(chunks))


def _given(spark, sf_dir):
    """Nodes of graph_nodes once each, and CONTAINS edges between them."""
    rows = table(spark, sf_dir, "graph_nodes").filter("node_id is not null")
    nodes = materialize(rows.groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.min("parent_node_id").alias("parent"), F.min("repository_id").alias("repository_id"), F.min("file_path").alias("file_path"), F.min("name").alias("name"), F.min("start_line").alias("start_line")), "given")
    edges = nodes.join(nodes.select(F.col("node_id").alias("source")), F.col("parent") == F.col("source")).select("source", F.col("node_id").alias("target"), F.lit("CONTAINS").alias("relationship"))
    return nodes, edges


def graph_summary(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.graph_statistics(nodes, graph.with_inverses(edges))


def graph_components(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.connected_components(edges, nodes)


def graph_descendants(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.reachable(edges, nodes.filter("node_type = 'repository'"), 3)


def graph_ancestors(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.reachable(edges, nodes.filter("node_type = 'method'"), 3, incoming=True)


def graph_paths(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    graph_of = F.regexp_extract("node_id", "^[a-z_]+:([^:]+)", 1)
    tops = nodes.filter("node_type = 'repository'").select(graph_of.alias("g"), F.col("node_id").alias("source"))
    ends = nodes.filter("node_type = 'method'").select(graph_of.alias("g"), F.col("node_id").alias("target"))
    found = graph.shortest_paths(edges, tops.join(ends, "g"), ["contains"])
    return found.select("source", "target", "hops", F.array_join("path", " > ").alias("path"))


def graph_subgraph(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.induced_edges(nodes.filter("node_type in ('file', 'class')"), edges)


def graph_last_definitions(spark, sf_dir):
    nodes, _ = _given(spark, sf_dir)
    symbols = nodes.filter("node_type in ('class', 'function', 'method') and file_path is not null")
    calls = symbols.select("repository_id", "file_path", F.col("name").alias("callee")).distinct()
    return graph.resolve_calls(calls, symbols.withColumnRenamed("name", "symbol_name").withColumn("start_line", F.coalesce("start_line", F.lit(0))))


def graph_degrees(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.degrees(nodes, graph.with_inverses(edges))


def graph_highlight(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.highlighted(edges, nodes.filter("node_type = 'class'"))


QUERIES = {f.__name__: f for f in (graph_file_nodes, graph_file_edges, graph_relationships, graph_imports, graph_summary, graph_components, graph_descendants, graph_ancestors, graph_paths, graph_subgraph, graph_last_definitions, graph_degrees, graph_highlight)}

_CLEAN = "regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '')"
_FILES = f"""
f AS (SELECT DISTINCT repository_id, {_CLEAN} AS file_path FROM code_chunks WHERE repository_id IS NOT NULL AND length({_CLEAN}) > 0),
d AS (SELECT DISTINCT repository_id, array_to_string(p[:k], '/') AS dir FROM (SELECT repository_id, p, unnest(range(1, len(p))) AS k FROM (SELECT repository_id, string_split(file_path, '/') AS p FROM f))),
n AS (
  SELECT DISTINCT 'repository:' || repository_id AS node_id, 'repository' AS node_type, repository_id, CAST(repository_id AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS file_path FROM f
  UNION ALL SELECT 'directory:' || repository_id || ':' || dir, 'directory', repository_id, string_split(dir, '/')[-1], dir FROM d
  UNION ALL SELECT 'file:' || repository_id || ':' || file_path, 'file', repository_id, string_split(file_path, '/')[-1], file_path FROM f
),
c AS (
  SELECT CASE WHEN file_path NOT LIKE '%/%' THEN 'repository:' || repository_id ELSE 'directory:' || repository_id || ':' || regexp_extract(file_path, '^(.*)/[^/]*$', 1) END AS source, node_id AS target
  FROM n WHERE node_type <> 'repository'
),
e AS (SELECT source, target, 'CONTAINS' AS relationship FROM c UNION ALL SELECT target, source, 'DEFINED_IN' FROM c)
"""
_GIVEN = """
n AS (
  SELECT node_id, min(node_type) AS node_type, min(parent_node_id) AS parent, min(repository_id) AS repository_id, min(file_path) AS file_path, min(name) AS name, min(start_line) AS start_line
  FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY node_id
),
c AS (SELECT p.node_id AS source, n.node_id AS target FROM n JOIN n p ON n.parent = p.node_id)
"""
_REACH = """
, r AS (
  SELECT node_id AS start, node_id, 0 AS depth FROM n WHERE node_type = '{kind}'
  UNION SELECT r.start, c.{to}, r.depth + 1 FROM r JOIN c ON c.{at} = r.node_id WHERE r.depth < 3
)
SELECT start, node_id, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node_id <> start GROUP BY start, node_id
"""
_PARTS = ", both_ways AS (SELECT source AS a, target AS b FROM c UNION SELECT target, source FROM c), w AS (SELECT node_id, node_id AS other FROM n UNION SELECT w.node_id, both_ways.b FROM w JOIN both_ways ON both_ways.a = w.other), parts AS (SELECT node_id, min(other) AS component FROM w GROUP BY node_id)"

SQL = {
    "graph_degrees": f"WITH {_GIVEN} SELECT node_id, CAST(coalesce(o, 0) + coalesce(i, 0) AS BIGINT) AS n_out, CAST(coalesce(o, 0) + coalesce(i, 0) AS BIGINT) AS n_in FROM n LEFT JOIN (SELECT source, count(*) AS o FROM c GROUP BY 1) ON source = node_id LEFT JOIN (SELECT target, count(*) AS i FROM c GROUP BY 1) ON target = node_id",
    "graph_highlight": f"WITH {_GIVEN}, s AS (SELECT node_id FROM n WHERE node_type = 'class') SELECT node_id FROM s UNION SELECT target FROM c WHERE source IN (SELECT node_id FROM s) UNION SELECT source FROM c WHERE target IN (SELECT node_id FROM s)",
    "graph_file_nodes": f"WITH {_FILES} SELECT * FROM n",
    "graph_file_edges": f"WITH {_FILES} SELECT * FROM e",
    "graph_relationships": f"WITH {_FILES} SELECT relationship, count(*) AS n_edges FROM e GROUP BY relationship",
    "graph_imports": f"""WITH {_FILES}, py AS (SELECT repository_id, {_CLEAN} AS file_path, source_code FROM code_chunks WHERE repository_id IS NOT NULL AND lower(file_path) LIKE '%.py'),
script AS (SELECT repository_id, {_CLEAN} AS file_path, source_code FROM code_chunks WHERE repository_id IS NOT NULL AND regexp_matches(lower(file_path), '\\.(js|mjs|cjs|jsx|ts|tsx)$')),
modules AS (SELECT repository_id, file_path, unnest(regexp_extract_all(source_code, '(?m)^import[ \\t]+([\\w.]+(?:[ \\t]+as[ \\t]+\\w+)?(?:[ \\t]*,[ \\t]*[\\w.]+(?:[ \\t]+as[ \\t]+\\w+)?)*)', 1)) AS m FROM py),
i AS (
  SELECT repository_id, file_path, string_split(trim(x), ' ')[1] AS import_text FROM (SELECT repository_id, file_path, unnest(string_split(replace(m, chr(9), ' '), ',')) AS x FROM modules)
  UNION SELECT repository_id, file_path, unnest(regexp_extract_all(source_code, '(?m)^from[ \\t]+([.\\w]+)[ \\t]+import\\b', 1)) FROM py
  UNION SELECT repository_id, file_path, unnest(regexp_extract_all(source_code, '(?m)^(?:import|export)\\b[^''"`;()=]*[''"]([^''"\\n]+)[''"]', 1)) FROM script
  UNION SELECT repository_id, file_path, unnest(regexp_extract_all(source_code, '(?m)^(?:const|let|var)\\b[^''"`;()]*=\\s*require\\(\\s*[''"]([^''"\\n]+)[''"]', 1)) FROM script
), k AS (SELECT *, regexp_replace(replace(import_text, '.', '/'), '^/+|/+$', '', 'g') AS wanted FROM i), s AS (SELECT *, regexp_replace(file_path, '\\.[^./]*$', '') AS stem FROM f)
SELECT k.repository_id, k.file_path, k.import_text, min(s.file_path) AS target_path
FROM k LEFT JOIN s ON s.repository_id = k.repository_id AND k.wanted <> '' AND (s.stem = k.wanted OR ends_with(s.stem, '/' || k.wanted))
GROUP BY k.repository_id, k.file_path, k.import_text""",
    "graph_summary": f"""WITH RECURSIVE {_GIVEN} {_PARTS}
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT 2 * count(*) FROM c) AS n_edges, round((SELECT 2 * count(*) FROM c) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1.0)), 9) AS density,
       (SELECT count(*) FROM n WHERE node_id NOT IN (SELECT source FROM c UNION SELECT target FROM c)) AS n_isolated, (SELECT count(DISTINCT component) FROM parts) AS n_components""",
    "graph_components": f"WITH RECURSIVE {_GIVEN} {_PARTS} SELECT node_id, component FROM parts",
    "graph_descendants": f"WITH RECURSIVE {_GIVEN}" + _REACH.format(kind="repository", to="target", at="source"),
    "graph_ancestors": f"WITH RECURSIVE {_GIVEN}" + _REACH.format(kind="method", to="source", at="target"),
    "graph_paths": f"""WITH RECURSIVE {_GIVEN}, p AS (
  SELECT node_id AS source, node_id AS target, 0 AS hops, node_id AS path FROM n WHERE node_type = 'repository'
  UNION ALL SELECT p.source, c.target, p.hops + 1, p.path || ' > ' || c.target FROM p JOIN c ON c.source = p.target WHERE NOT contains(' > ' || p.path || ' > ', ' > ' || c.target || ' > ')
)
SELECT source, target, CAST(hops AS BIGINT) AS hops, path FROM p JOIN n ON n.node_id = target
WHERE n.node_type = 'method' AND regexp_extract(source, '^[a-z_]+:([^:]+)', 1) = regexp_extract(target, '^[a-z_]+:([^:]+)', 1)""",
    "graph_subgraph": f"WITH {_GIVEN} SELECT source, target, 'CONTAINS' AS relationship FROM c JOIN n a ON a.node_id = source JOIN n b ON b.node_id = target WHERE a.node_type IN ('file', 'class') AND b.node_type IN ('file', 'class')",
    "graph_last_definitions": f"""WITH {_GIVEN}
SELECT repository_id, file_path, name AS callee, node_id AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id, file_path, name ORDER BY coalesce(start_line, 0) DESC, node_id DESC) AS k FROM n WHERE node_type IN ('class', 'function', 'method') AND file_path IS NOT NULL
) WHERE k = 1""",
}
