"""Queries of what keeps the tables: upserts, deletions, changes, generations, listings, health, and the whole graph."""

from pyspark.sql import functions as F

from forgeline.functions import text as T
from forgeline.operators import analytics, catalog, graph, manifests, patches, retrieval
from forgeline.plans.graphs import _given
from forgeline.session import scratch_path, table
from forgeline.sources import repository


def _files(spark, sf_dir):
    """Path and checksum of each file of code_chunks once."""
    c = table(spark, sf_dir, "code_chunks").filter("file_id is not null")
    return c.groupBy("file_id").agg(F.min("repository_id").alias("repository_id"), F.min(T.clean_path(F.col("file_path"))).alias("file_path"), F.sha2(F.coalesce(F.min("source_code"), F.lit("")), 256).alias("digest"))


def _snapshots(spark, sf_dir):
    """The files, and what they might be later: a third changed, an eighth gone, a ninth under a new id."""
    old = _files(spark, sf_dir)
    changed = F.when(F.col("file_id") % 3 == 0, F.sha2("digest", 256)).otherwise(F.col("digest"))
    new = old.filter("file_id % 8 <> 5").withColumn("digest", changed).withColumn("file_id", F.when(F.col("file_id") % 9 == 4, -F.col("file_id")).otherwise(F.col("file_id")))
    return old, new


def files_upsert(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return catalog.upsert(old, new, ["file_id"])


def files_changed(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return catalog.changed_files(old, new, "file_id", "digest")


def files_of_generation(spark, sf_dir):
    """The later snapshot, staged and published over the earlier one, beside a discarded third."""
    old, new = _snapshots(spark, sf_dir)
    g = catalog.Generations(spark, scratch_path(spark, "generations"))
    g.publish(g.stage(old))
    g.publish(g.stage(new))
    g.discard(g.stage(old.limit(0)))
    return g.read()


def _kept(spark, sf_dir):
    repositories = table(spark, sf_dir, "repositories").select("id", "indexing_status", "workspace_id").distinct()
    responses = table(spark, sf_dir, "query_responses").select("response_id", "repository_id").distinct()
    gone = F.col("indexing_status").isin("deleting", "failed_import")
    return catalog.delete_cascade(repositories, gone, {"files": (_files(spark, sf_dir), "repository_id"), "responses": (responses, "repository_id")})


def delete_repositories(spark, sf_dir):
    return _kept(spark, sf_dir)[0]


def delete_cascaded(spark, sf_dir):
    _, left = _kept(spark, sf_dir)
    named = lambda name, key: left[name].select(F.lit(name).alias("kind"), F.col(key).alias("key"), "repository_id")
    return named("files", "file_id").union(named("responses", "response_id"))


def clear_files(spark, sf_dir):
    """All files but those of repository 17."""
    return catalog.delete_where(_files(spark, sf_dir), F.col("repository_id") == 17)


def repository_page(spark, sf_dir):
    return catalog.repository_list(table(spark, sf_dir, "repositories"), None, 50, 10).select("id", "repository_name", "created_at")


def tenant_repositories(spark, sf_dir):
    r = table(spark, sf_dir, "repositories")
    first = r.agg(F.min("workspace_id").alias("w")).first()["w"]
    return catalog.tenant(r, first or "none").select("id", "workspace_id").distinct()


def repository_lookup(spark, sf_dir):
    """By id and by name in the same way: equality of any columns."""
    return catalog.matching(table(spark, sf_dir, "repositories"), default_branch="main", is_private=False).select("id", "repository_name").distinct()


def import_decisions(spark, sf_dir):
    """Each stated address asked for in the workspace that has it and in the first of all."""
    r = table(spark, sf_dir, "repositories").filter("workspace_id is not null and repository_url is not null").select("workspace_id", "repository_url")
    everywhere = r.crossJoin(r.agg(F.min("workspace_id").alias("w"))).select(F.col("w").alias("workspace_id"), F.col("repository_url").alias("url"))  # one row
    return catalog.import_decisions(r.select("workspace_id", F.col("repository_url").alias("url")).union(everywhere), r)


def repository_health(spark, sf_dir):
    return catalog.repository_health(table(spark, sf_dir, "repositories"))


def repository_metrics(spark, sf_dir):
    return catalog.repository_metrics(table(spark, sf_dir, "repositories"), table(spark, sf_dir, "code_chunks"))


def embedding_progress(spark, sf_dir):
    return catalog.embedding_progress(table(spark, sf_dir, "repositories"), table(spark, sf_dir, "embeddings"))


def severity_counts(spark, sf_dir):
    """Levels of the whole numbers of the events' values, as scores in text."""
    e = table(spark, sf_dir, "events").select(manifests.severity(F.floor("value").cast("string")).alias("severity"))
    return e.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def version_status(spark, sf_dir):
    """Orders as packages: versions made of their numbers, compared and rated."""
    o = table(spark, sf_dir, "orders")
    installed = F.concat_ws(".", (F.col("o_orderkey") % 4).cast("string"), (F.col("o_custkey") % 11).cast("string"))
    latest = F.when(F.col("o_custkey") % 7 != 0, F.concat_ws(".", (F.col("o_custkey") % 4).cast("string"), (F.col("o_orderkey") % 11).cast("string"), F.lit("0")))
    status = manifests.dependency_status(F.concat(F.lit("^"), installed), latest, F.when(F.col("o_orderkey") % 13 == 0, 1))
    found = T.first_version(F.concat(F.lit(">= "), installed, F.lit(", < 9")))
    return o.select("o_orderkey", status.alias("status"), found.alias("version"))


def manifest_dependencies(spark, sf_dir):
    """Parts as requirements of fifty repositories, a manifest each, merged by name."""
    key = F.col("p_partkey")
    line = F.concat(F.translate("p_name", " ", "-"), F.lit("[extra] == "), (key % 5).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.when(key % 4 == 0, "; python_version < '3.9'").otherwise(""), F.when(key % 6 == 0, "  # pinned").otherwise(""))
    files = table(spark, sf_dir, "part").select((key % 50).alias("repository_id"), F.concat(F.lit("p"), key.cast("string"), F.lit("/requirements.txt")).alias("file_path"), line.alias("source_code"))
    return manifests.merged_dependencies(manifests.dependencies(files)).select("repository_id", "ecosystem", "source_file", "name", "installed", "scope")


def dependencies_enriched(spark, sf_dir):
    """Parts as packages beside the facts that a registry has of two thirds of them, in other letters."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    deps = p.select(key.alias("part"), F.lit("pypi").alias("ecosystem"), F.concat(F.lit("Pkg-"), key.cast("string")).alias("name"), F.concat((key % 5).cast("string"), F.lit(".1")).alias("installed"))
    faults = F.array_repeat(F.lit("advisory"), (F.col("p_size") % 9 == 0).cast("int"))
    facts = p.filter(key % 3 > 0).select(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("pkg-"), key.cast("string")).alias("name"), F.concat((F.col("p_size") % 5).cast("string"), F.lit(".1.0")).alias("latest"), faults.alias("vulnerabilities"))
    return manifests.enriched(deps, facts).select("part", "latest", F.col("n_vulnerabilities").cast("long").alias("n_vulnerabilities"), "status")


def advisories(spark, sf_dir):
    """Parts as advisory records in JSON, read back as levels and versions."""
    p = table(spark, sf_dir, "part")
    record = F.to_json(F.struct(
        F.array(F.struct((F.col("p_size") % 11).cast("string").alias("score"))).alias("severity"),
        F.array(F.struct(F.array(F.col("p_brand")).alias("versions"), F.array(F.struct(F.array(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("fixed"))).alias("events"))).alias("ranges"))).alias("affected"),
    ))
    rows = manifests.vulnerability_rows(p.select(F.col("p_partkey").alias("id"), record.alias("record")))
    return rows.select("id", "severity", F.array_join("affected_versions", ",").alias("affected"), F.array_join("fixed_versions", ",").alias("fixed"))


def patched_files(spark, sf_dir):
    """Documents as small files with a diff each, of which some meet another content, another hash or a protected path."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id").distinct()
    n, path = F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("keys/k"), F.col("doc_id").cast("string"), F.lit(".pem"))).otherwise(F.concat(F.lit("docs/d"), F.col("doc_id").cast("string")))
    files = d.select(path.alias("file_path"), F.concat(F.lit("head\n"), n, F.lit("\nend\n")).alias("source_code"))
    old = F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(n)
    diff = F.concat(F.lit("--- a/f\n+++ b/f\n@@ -1,3 +1,4 @@\n head\n-"), old, F.lit("\n+new "), n, F.lit("\n+more\n end\n"))
    edits = d.select(path.alias("file_path"), F.when(F.col("doc_id") % 5 == 0, F.lit("0" * 64)).alias("expected_hash"), diff.alias("diff"))
    return patches.apply_patches(files, edits)


def scanned_files(spark, sf_dir):
    """The files of code_chunks, written to a folder each under its id, and scanned: listing, pruning, size, contents."""
    c = table(spark, sf_dir, "code_chunks").filter("file_id is not null and length(source_code) > 0")
    once = c.groupBy("file_id").agg(F.min(T.clean_path(F.col("file_path"))).alias("file_path"), F.min("source_code").alias("source_code")).filter(T.is_safe_path(F.col("file_path")))
    folder = scratch_path(spark, "scan")
    repository.write_files(once.select(F.concat_ws("/", F.col("file_id").cast("string"), "file_path").alias("file_path"), "source_code"), folder).count()
    return repository.read_sources(spark, folder).select("file_path", "language", "n_bytes", "checksum")


def formatted_sizes(spark, sf_dir):
    return _sizes(spark, sf_dir).select("file_id", T.format_bytes(F.col("n_bytes")).alias("size"))


def _sizes(spark, sf_dir):
    return analytics.distinct_files(table(spark, sf_dir, "code_chunks")).select("file_id", F.col("n_bytes"))


def embeddable_documents(spark, sf_dir):
    from forgeline.operators.records import blank_texts

    return blank_texts(table(spark, sf_dir, "documents"), "doc_id", "text")[0].select("doc_id")


def tree_visible(spark, sf_dir):
    """The directories to be seen where those at the top are open."""
    tree = analytics.directory_tree(analytics.distinct_files(table(spark, sf_dir, "code_chunks")))
    return analytics.visible_tree(tree, tree.filter("depth = 1").select("repository_id", "dir")).select("repository_id", "dir", "depth")


def told_metadata(spark, sf_dir):
    """What is told of nodes, without code, by key."""
    n = table(spark, sf_dir, "graph_nodes").filter("node_id is not null and metadata is not null")
    marked = F.map_concat(F.map_filter("metadata", lambda k, _: ~k.isin("code", "seen")), F.create_map(F.lit("code"), F.lit("x"), F.lit("seen"), F.when(F.col("start_line").isNotNull(), "true")))
    return n.select("node_id", F.explode(retrieval.told_metadata(marked)).alias("key", "told")).distinct()


def cited_lines(spark, sf_dir):
    """Chunks of code_chunks as ranked results with their line ranges."""
    c = table(spark, sf_dir, "code_chunks").filter("file_id is not null and chunk_id is not null")
    records = c.groupBy("chunk_id").agg(F.min("repository_id").alias("repository_id"), F.min("start_line").alias("start_line"), F.min("end_line").alias("end_line"), F.min("file_path").alias("file_path"), F.min("symbol_name").alias("symbol_name"))
    ranked = records.select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), "chunk_id", "file_path", "symbol_name")
    cited = retrieval.citations(ranked, records.withColumn("metadata", F.create_map(F.lit("code"), F.lit("x"))))
    return cited.select("repository_id", "file_path", "symbol_name", "start_line", "end_line")


def context_sanitised(spark, sf_dir):
    return retrieval.sanitised(_files(spark, sf_dir)).select("file_id", "file_path")


def proposals(spark, sf_dir):
    """Responses written as proposals, a third of them in a fence and a fifth cut off."""
    r = table(spark, sf_dir, "query_responses").filter("response_id is not null").groupBy("response_id").agg(F.min("query").alias("summary"))
    plain = F.to_json(F.struct("summary", F.array(F.struct(F.lit("a.py").alias("file_path"), F.lit("@@").alias("diff"))).alias("edits")))
    body = F.when(F.col("response_id") % 5 == 0, F.expr("left(plain, length(plain) - 2)")).when(F.col("response_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("plain"), F.lit("\n```"))).otherwise(F.col("plain"))
    p = patches.parsed_proposals(r.withColumn("plain", plain).withColumn("answer", body), "response_id", "answer")
    return p.select("response_id", "valid", "summary", F.size("edits").cast("long").alias("n_edits"))


def errors_in_order(spark, sf_dir):
    """The errors of each repository's runs, each once at its first place."""
    e = table(spark, sf_dir, "parse_results").filter("repository_id is not null").select("repository_id", "run_id", F.posexplode("errors").alias("at", "error"))
    return catalog.ordered_distinct(e, ["repository_id"], F.col("run_id") * 1000 + F.col("at"), "error")


def nodes_of_type(spark, sf_dir):
    return graph.nodes_listing(_given(spark, sf_dir)[0], None, None, "Class").select("node_id", "name")


def nodes_by_precedence(spark, sf_dir):
    """The name is not looked at where a path is given."""
    nodes, _ = _given(spark, sf_dir)
    path = nodes.agg(F.min("file_path").alias("p")).first()["p"]
    return graph.nodes_listing(nodes, path, "nothing", "file").select("node_id", "file_path")


def edges_of_kind(spark, sf_dir):
    return graph.edges_listing(graph.with_inverses(_given(spark, sf_dir)[1]), " defined_in ")


def graph_neighbours(spark, sf_dir):
    return graph.neighbours(graph.related(graph.with_inverses(_given(spark, sf_dir)[1]), ["contains"]), incoming=True)


def graph_dangling(spark, sf_dir):
    """Stated parents that are no node."""
    nodes, _ = _given(spark, sf_dir)
    stated = nodes.filter("parent <> ''").select(F.col("parent").alias("source"), F.col("node_id").alias("target"), F.lit("CONTAINS").alias("relationship"))
    return graph.dangling_edges(nodes, stated)


def graph_repeated(spark, sf_dir):
    return graph.repeated_nodes(table(spark, sf_dir, "graph_nodes").filter("node_id is not null"))


def graph_serialised(spark, sf_dir):
    """Nodes and edges as they are exchanged, read back from their JSON."""
    nodes, edges = _given(spark, sf_dir)
    n = graph.serialised_nodes(nodes).select(F.lit("node").alias("kind"), F.get_json_object("json", "$.id").alias("a"), F.get_json_object("json", "$.type").alias("b"))
    e = graph.serialised_edges(edges).select(F.lit("edge").alias("kind"), F.get_json_object("json", "$.source").alias("a"), F.get_json_object("json", "$.target").alias("b"))
    return n.union(e)


def graph_health(spark, sf_dir):
    nodes, edges = _given(spark, sf_dir)
    return graph.graph_health(nodes, edges, table(spark, sf_dir, "repositories"))


def _whole(spark, sf_dir):
    """The graph of the given nodes' files and symbols: a class has the first word of its name as base, a symbol calls
    what it lies in, and the imports are those of the sources of the same repository."""
    rows = table(spark, sf_dir, "graph_nodes").filter("node_id is not null").groupBy("node_id").agg(
        *[F.min(c).alias(c) for c in ("repository_id", "node_type", "name", "file_path", "symbol_type", "start_line", "parent_node_id")]
    )
    named = rows.filter("repository_id is not null and length(file_path) > 0").withColumn("file_path", T.clean_path(F.col("file_path")))
    files = named.filter("node_type = 'file' or symbol_type is not null").select("repository_id", "file_path").distinct()
    symbols = named.filter("symbol_type is not null and length(name) > 0").join(rows.select(F.col("node_id").alias("p"), F.col("name").alias("up"), F.col("symbol_type").alias("up_type")), F.col("parent_node_id") == F.col("p"), "left")
    symbols = symbols.select("repository_id", "file_path", "symbol_type", F.col("name").alias("symbol_name"), F.when(F.col("up_type").isNotNull(), F.col("up")).alias("parent_symbol"), "start_line")
    once = symbols.select("repository_id", "file_path", "symbol_name", "parent_symbol", "symbol_type").distinct()
    calls = once.filter("parent_symbol is not null").select("repository_id", "file_path", "symbol_name", F.col("parent_symbol").alias("callee")).distinct()
    bases = once.filter("symbol_type = 'class'").select("repository_id", "file_path", "symbol_name", F.regexp_extract("symbol_name", "^[A-Z]?[a-z]+", 0).alias("base")).filter("base <> ''").distinct()
    found = graph.file_imports(table(spark, sf_dir, "code_chunks")).withColumn("repository_id", F.col("repository_id").cast("string"))
    imports = found.join(files, ["repository_id", "file_path"], "left_semi")
    return graph.full_graph(files, symbols, imports, calls, bases)


def graph_full_nodes(spark, sf_dir):
    return _whole(spark, sf_dir)[0]


def graph_full_edges(spark, sf_dir):
    return _whole(spark, sf_dir)[1].groupBy("source", "target", "relationship").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        files_upsert, files_changed, files_of_generation, delete_repositories, delete_cascaded, clear_files, repository_page, tenant_repositories, repository_lookup, import_decisions, repository_health, repository_metrics,
        embedding_progress, severity_counts, version_status, manifest_dependencies, dependencies_enriched, advisories, patched_files, scanned_files, formatted_sizes, embeddable_documents, tree_visible, told_metadata, cited_lines, context_sanitised, proposals, errors_in_order, nodes_of_type, nodes_by_precedence,
        edges_of_kind, graph_neighbours, graph_dangling, graph_repeated, graph_serialised, graph_health, graph_full_nodes, graph_full_edges,
    )
}

_CLEAN = "regexp_replace(replace({c}, '\\', '/'), '^(\\./)+', '')"
_OLD = f"old AS (SELECT file_id, min(repository_id) AS repository_id, min({_CLEAN.format(c='file_path')}) AS file_path, sha256(coalesce(min(source_code), '')) AS digest FROM code_chunks WHERE file_id IS NOT NULL GROUP BY file_id)"
_NEW = f"{_OLD}, new AS (SELECT CASE WHEN file_id % 9 = 4 THEN -file_id ELSE file_id END AS file_id, repository_id, file_path, CASE WHEN file_id % 3 = 0 THEN sha256(digest) ELSE digest END AS digest FROM old WHERE file_id % 8 <> 5)"
_NOW = "now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS k FROM repositories) WHERE k = 1)"
_REPOS = "r AS (SELECT DISTINCT id, indexing_status, workspace_id FROM repositories), gone AS (SELECT DISTINCT id FROM r WHERE indexing_status IN ('deleting', 'failed_import'))"
_NODES = "n AS (SELECT node_id, min(node_type) AS node_type, min(parent_node_id) AS parent, min(repository_id) AS repository_id, min(file_path) AS file_path, min(name) AS name, min(start_line) AS start_line, min(symbol_type) AS symbol_type FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY node_id), c AS (SELECT p.node_id AS source, n.node_id AS target FROM n JOIN n p ON n.parent = p.node_id)"
_PROTECTED = "regexp_matches(lower(file_path), '(?:^|/)(?:\\.env[^/]*|credentials[^/]*|secrets[^/]*|[^/]*\\.(?:pem|key))$|(?:^|/)\\.git/')"
_FULL = f"""
WITH {_NODES},
m AS (SELECT node_id, repository_id, node_type, name, {_CLEAN.format(c='file_path')} AS file_path, symbol_type, start_line, parent FROM n WHERE repository_id IS NOT NULL AND length(file_path) > 0),
f AS (SELECT DISTINCT repository_id, file_path FROM m WHERE node_type = 'file' OR symbol_type IS NOT NULL),
d AS (SELECT DISTINCT repository_id, array_to_string(p[:k], '/') AS dir FROM (SELECT repository_id, p, unnest(range(1, len(p))) AS k FROM (SELECT repository_id, string_split(file_path, '/') AS p FROM f))),
s AS (
  SELECT m.repository_id, m.file_path, m.symbol_type, m.name, CASE WHEN u.symbol_type IS NOT NULL THEN u.name END AS up, coalesce(m.start_line, 0) AS line,
         'symbol:' || m.repository_id || ':' || m.file_path || ':' || m.name || ':' || coalesce(m.start_line, 0) AS node_id
  FROM m LEFT JOIN n u ON u.node_id = m.parent WHERE m.symbol_type IS NOT NULL AND length(m.name) > 0
),
last AS (SELECT repository_id, file_path, name, arg_max(node_id, line) AS node_id FROM s GROUP BY 1, 2, 3),
pylist AS (SELECT repository_id, file_path, unnest(regexp_extract_all(source_code, '(?m)^import[ \\t]+([\\w.]+(?:[ \\t]+as[ \\t]+\\w+)?(?:[ \\t]*,[ \\t]*[\\w.]+(?:[ \\t]+as[ \\t]+\\w+)?)*)', 1)) AS m FROM code_chunks WHERE lower(file_path) LIKE '%.py'),
pyimport AS (SELECT DISTINCT repository_id, file_path, string_split(trim(x), ' ')[1] AS import_text FROM (SELECT repository_id, file_path, unnest(string_split(replace(m, chr(9), ' '), ',')) AS x FROM pylist)),
imported AS (
  SELECT repository_id, file_path, import_text FROM pyimport
  UNION SELECT repository_id, file_path, unnest(regexp_extract_all(source_code, '(?m)^from[ \\t]+([.\\w]+)[ \\t]+import\\b', 1)) FROM code_chunks WHERE lower(file_path) LIKE '%.py'
  UNION SELECT repository_id, file_path, unnest(list_concat(regexp_extract_all(source_code, '(?m)^(?:import|export)\\b[^''"`;()=]*[''"]([^''"\\n]+)[''"]', 1),
    regexp_extract_all(source_code, '(?m)^(?:const|let|var)\\b[^''"`;()]*=\\s*require\\(\\s*[''"]([^''"\\n]+)[''"]', 1))) FROM code_chunks WHERE regexp_matches(lower(file_path), '\\.(js|mjs|cjs|jsx|ts|tsx)$')
),
i AS (SELECT DISTINCT f.repository_id, f.file_path, import_text, regexp_replace(replace(import_text, '.', '/'), '^/+|/+$', '', 'g') AS wanted FROM imported JOIN f ON f.repository_id = CAST(imported.repository_id AS VARCHAR) AND f.file_path = {_CLEAN.format(c='imported.file_path')}),
stems AS (SELECT *, regexp_replace(file_path, '\\.[^./]*$', '') AS stem FROM f),
hits AS (SELECT i.repository_id, i.file_path, i.import_text, min(stems.file_path) AS target FROM i LEFT JOIN stems ON stems.repository_id = i.repository_id AND i.wanted <> '' AND (stem = wanted OR ends_with(stem, '/' || wanted)) GROUP BY 1, 2, 3),
calls AS (SELECT DISTINCT s.repository_id, s.file_path, s.name, s.up AS callee FROM s WHERE up IS NOT NULL),
called AS (SELECT calls.repository_id, callee, a.node_id AS source, b.node_id AS found FROM calls JOIN last a ON (a.repository_id, a.file_path, a.name) = (calls.repository_id, calls.file_path, calls.name) LEFT JOIN last b ON (b.repository_id, b.file_path, b.name) = (calls.repository_id, calls.file_path, calls.callee)),
heirs AS (SELECT DISTINCT last.repository_id, last.node_id AS source, regexp_extract(s.name, '^[A-Z]?[a-z]+') AS base FROM s JOIN last ON (last.repository_id, last.file_path, last.name) = (s.repository_id, s.file_path, s.name) WHERE s.symbol_type = 'class' AND regexp_extract(s.name, '^[A-Z]?[a-z]+') <> ''),
tree AS (
  SELECT DISTINCT 'repository:' || repository_id AS node_id, 'repository' AS node_type, repository_id, repository_id AS name, CAST(NULL AS VARCHAR) AS file_path FROM f
  UNION ALL SELECT 'directory:' || repository_id || ':' || dir, 'directory', repository_id, string_split(dir, '/')[-1], dir FROM d
  UNION ALL SELECT 'file:' || repository_id || ':' || file_path, 'file', repository_id, string_split(file_path, '/')[-1], file_path FROM f
)
"""

SQL = {
    "files_upsert": f"WITH {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE file_id NOT IN (SELECT file_id FROM new)",
    "files_changed": f"WITH {_NEW} SELECT coalesce(old.file_id, new.file_id) AS file_id, CASE WHEN old.file_id IS NULL THEN 'added' WHEN new.file_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.file_id = new.file_id WHERE old.file_id IS NULL OR new.file_id IS NULL OR old.digest <> new.digest",
    "files_of_generation": f"WITH {_NEW} SELECT * FROM new",
    "delete_repositories": f"WITH {_REPOS} SELECT * FROM r WHERE coalesce(indexing_status NOT IN ('deleting', 'failed_import'), true)",
    "delete_cascaded": f"WITH {_OLD}, {_REPOS} SELECT 'files' AS kind, file_id AS key, repository_id FROM old WHERE repository_id IS NULL OR repository_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'responses', response_id, repository_id FROM (SELECT DISTINCT response_id, repository_id FROM query_responses) WHERE repository_id IS NULL OR repository_id NOT IN (SELECT id FROM gone)",
    "clear_files": f"WITH {_OLD} SELECT * FROM old WHERE repository_id IS DISTINCT FROM 17",
    "repository_page": f"WITH {_NOW} SELECT id, repository_name, created_at FROM now ORDER BY created_at DESC NULLS LAST, id LIMIT 50 OFFSET 10",
    "tenant_repositories": "SELECT DISTINCT id, workspace_id FROM repositories WHERE workspace_id = (SELECT min(workspace_id) FROM repositories)",
    "repository_lookup": "SELECT DISTINCT id, repository_name FROM repositories WHERE default_branch = 'main' AND is_private = false",
    "import_decisions": "WITH k AS (SELECT DISTINCT workspace_id, repository_url AS url FROM repositories WHERE workspace_id IS NOT NULL AND repository_url IS NOT NULL) SELECT workspace_id, url, 'known' AS decision FROM k UNION ALL SELECT * FROM (SELECT DISTINCT (SELECT min(workspace_id) FROM k) AS workspace_id, url, 'create' AS decision FROM k) a WHERE (workspace_id, url) NOT IN (SELECT (workspace_id, url) FROM k)",
    "repository_health": f"WITH {_NOW} SELECT count(*) AS total, count(*) FILTER (WHERE indexing_status = 'ready') AS indexed, count(*) FILTER (WHERE indexing_status = 'index_failed') AS failed, count(*) FILTER (WHERE indexing_status IN ('indexing', 'pending')) AS pending FROM now",
    "repository_metrics": f"WITH {_NOW} SELECT count(*) AS total, count(*) FILTER (WHERE indexing_status = 'ready') AS indexed, count(*) FILTER (WHERE coalesce(indexing_status, '') NOT IN ('ready', 'index_failed', 'failed_import')) AS pending, count(*) FILTER (WHERE indexing_status IN ('index_failed', 'failed_import', 'failed')) AS failed, CAST(sum(total_chunks) AS BIGINT) AS n_chunks, (SELECT count(DISTINCT file_id) FROM code_chunks) AS n_files FROM now",
    "embedding_progress": f"WITH {_NOW} SELECT total_chunks, embedded, greatest(total_chunks - embedded, 0) AS pending FROM (SELECT CAST(coalesce(sum(total_chunks), 0) AS BIGINT) AS total_chunks, (SELECT count(*) FROM embeddings) AS embedded FROM now)",
    "severity_counts": "SELECT CASE WHEN v IS NULL THEN 'Unknown' WHEN v LIKE '10%' THEN 'Critical' WHEN v[1] IN ('7', '8', '9') THEN 'High' WHEN v[1] IN ('4', '5', '6') THEN 'Moderate' ELSE 'Low' END AS severity, count(*) AS n FROM (SELECT CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events) GROUP BY 1",
    "version_status": """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'vulnerable' WHEN o_custkey % 7 = 0 THEN 'unknown' WHEN [o_orderkey % 4, o_custkey % 11] < [o_custkey % 4, o_orderkey % 11, 0] THEN 'outdated' ELSE 'up-to-date' END AS status,
(o_orderkey % 4) || '.' || (o_custkey % 11) AS version FROM orders""",
    "manifest_dependencies": """SELECT repository_id, 'pypi' AS ecosystem, arg_max(file_path, file_path) AS source_file, arg_max(name, file_path) AS name, arg_max(installed, file_path) AS installed, 'runtime' AS scope
FROM (SELECT p_partkey % 50 AS repository_id, 'p' || p_partkey || '/requirements.txt' AS file_path, replace(p_name, ' ', '-') AS name, (p_partkey % 5) || '.' || p_size AS installed FROM part) GROUP BY repository_id, lower(name)""",
    "dependencies_enriched": """SELECT p_partkey AS part, CASE WHEN p_partkey % 3 > 0 THEN (p_size % 5) || '.1.0' END AS latest, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size % 9 = 0 AS BIGINT) END AS n_vulnerabilities,
CASE WHEN p_partkey % 3 = 0 THEN 'unknown' WHEN p_size % 9 = 0 THEN 'vulnerable' WHEN p_partkey % 5 <= p_size % 5 THEN 'outdated' ELSE 'up-to-date' END AS status FROM part""",
    "advisories": "SELECT p_partkey AS id, CASE WHEN p_size % 11 = 10 THEN 'Critical' WHEN p_size % 11 >= 7 THEN 'High' WHEN p_size % 11 >= 4 THEN 'Moderate' ELSE 'Low' END AS severity, p_brand AS affected, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS fixed FROM part",
    "patched_files": """SELECT CASE WHEN doc_id % 11 = 0 THEN 'keys/k' || doc_id || '.pem' ELSE 'docs/d' || doc_id END AS file_path,
CASE WHEN doc_id % 11 = 0 THEN 'protected' WHEN doc_id % 5 = 0 THEN 'conflict' WHEN doc_id % 7 = 0 THEN 'line 2 differs' ELSE 'applied' END AS outcome,
CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'head' || chr(10) || 'new ' || doc_id || chr(10) || 'more' || chr(10) || 'end' || chr(10) ELSE 'head' || chr(10) || doc_id || chr(10) || 'end' || chr(10) END AS source_code
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)""",
    "scanned_files": f"""WITH o AS (SELECT file_id, min({_CLEAN.format(c='file_path')}) AS path, min(source_code) AS source FROM code_chunks WHERE file_id IS NOT NULL AND length(source_code) > 0 GROUP BY file_id)
SELECT file_id || '/' || path AS file_path, CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN regexp_matches(lower(path), '\\.tsx?$') THEN 'typescript' ELSE 'javascript' END AS language, strlen(source) AS n_bytes, sha256(source) AS checksum
FROM o WHERE regexp_matches(lower(path), '\\.(py|js|jsx|mjs|cjs|ts|tsx)$') AND strlen(source) <= 1048576 AND NOT regexp_matches(path, '(?:^|/)(?:\\.git|\\.hg|\\.svn|\\.venv|venv|node_modules|__pycache__|dist|build|\\.idea)/')
AND NOT regexp_matches(path, '^/|^[A-Za-z]:|(?:^|/)\\.\\.(?:/|$)')""",
    "formatted_sizes": "SELECT file_id, CASE WHEN n IS NULL THEN 'Not calculated' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size FROM (SELECT file_id, min(strlen(source_code)) AS n FROM code_chunks WHERE file_id IS NOT NULL GROUP BY file_id)",
    "embeddable_documents": "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0",
    "tree_visible": f"WITH {_OLD}, p AS (SELECT repository_id, string_split(file_path, '/') AS p FROM old WHERE repository_id IS NOT NULL AND file_path IS NOT NULL) SELECT DISTINCT repository_id, array_to_string(p[:k], '/') AS dir, CAST(k AS BIGINT) AS depth FROM (SELECT repository_id, p, unnest(range(1, least(len(p), 3))) AS k FROM p)",
    "told_metadata": """SELECT DISTINCT node_id, key, told FROM (
  SELECT node_id, e.key AS key, e.value AS told FROM (SELECT node_id, unnest(map_entries(metadata)) AS e FROM graph_nodes WHERE node_id IS NOT NULL) WHERE e.key NOT IN ('code', 'seen')
  UNION ALL SELECT node_id, 'seen', CASE WHEN start_line IS NULL THEN 'None' ELSE 'True' END FROM graph_nodes WHERE node_id IS NOT NULL AND metadata IS NOT NULL)""",
    "cited_lines": "SELECT min(repository_id) AS repository_id, min(file_path) AS file_path, min(symbol_name) AS symbol_name, min(start_line) AS start_line, min(end_line) AS end_line FROM code_chunks WHERE file_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id",
    "context_sanitised": f"WITH {_OLD} SELECT file_id, file_path FROM old WHERE length(file_path) > 0 AND NOT {_PROTECTED} AND NOT regexp_matches(file_path, '^/|^[A-Za-z]:|(?:^|/)\\.\\.(?:/|$)')",
    "proposals": "SELECT response_id, response_id % 5 <> 0 AS valid, CASE WHEN response_id % 5 <> 0 THEN min(query) END AS summary, CAST(CASE WHEN response_id % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_edits FROM query_responses WHERE response_id IS NOT NULL GROUP BY response_id",
    "errors_in_order": "SELECT repository_id, min(run_id * 1000 + k - 1) AS position, errors[k] AS error FROM (SELECT repository_id, run_id, errors, unnest(range(1, len(errors) + 1)) AS k FROM parse_results WHERE repository_id IS NOT NULL) GROUP BY repository_id, errors[k]",
    "nodes_of_type": f"WITH {_NODES} SELECT node_id, name FROM n WHERE node_type = 'class'",
    "nodes_by_precedence": f"WITH {_NODES} SELECT node_id, file_path FROM n WHERE file_path = (SELECT min(file_path) FROM n)",
    "edges_of_kind": f"WITH {_NODES} SELECT target AS source, source AS target, 'DEFINED_IN' AS relationship FROM c",
    "graph_neighbours": f"WITH {_NODES} SELECT DISTINCT target AS node_id, source AS neighbour FROM c",
    "graph_dangling": f"WITH {_NODES} SELECT parent AS source, node_id AS target, 'CONTAINS' AS relationship FROM n WHERE parent <> '' AND parent NOT IN (SELECT node_id FROM n)",
    "graph_repeated": "SELECT node_id, count(*) AS count FROM graph_nodes WHERE node_id IS NOT NULL GROUP BY node_id HAVING count(*) > 1",
    "graph_serialised": f"WITH {_NODES} SELECT 'node' AS kind, node_id AS a, node_type AS b FROM n UNION ALL SELECT 'edge', source, target FROM c",
    "graph_health": f"WITH {_NODES}, k AS (SELECT repository_id, count(*) AS n_nodes FROM n GROUP BY 1), l AS (SELECT n.repository_id, count(*) AS n_edges FROM c JOIN n ON n.node_id = c.source GROUP BY 1) SELECT r.id AS repository_id, k.n_nodes IS NOT NULL AS available, coalesce(k.n_nodes, 0) AS n_nodes, coalesce(l.n_edges, 0) AS n_edges FROM (SELECT DISTINCT CAST(id AS VARCHAR) AS id FROM repositories WHERE id IS NOT NULL) r LEFT JOIN k ON k.repository_id = r.id LEFT JOIN l ON l.repository_id = r.id",
    "graph_full_nodes": _FULL
    + """SELECT * FROM tree
UNION ALL SELECT DISTINCT node_id, CASE WHEN symbol_type IN ('class', 'interface', 'enum') THEN 'class' WHEN symbol_type = 'method' THEN 'method' ELSE 'function' END, repository_id, name, file_path FROM s
UNION ALL SELECT DISTINCT 'external:' || repository_id || ':external_symbol:' || x, 'external_symbol', repository_id, x, NULL FROM (SELECT repository_id, callee AS x FROM called WHERE found IS NULL UNION SELECT repository_id, base FROM heirs)
UNION ALL SELECT DISTINCT 'external:' || repository_id || ':external_module:' || import_text, 'external_module', repository_id, import_text, NULL FROM hits WHERE target IS NULL""",
    "graph_full_edges": _FULL
    + """, e AS (
  SELECT CASE WHEN file_path NOT LIKE '%/%' THEN 'repository:' || repository_id ELSE 'directory:' || repository_id || ':' || regexp_extract(file_path, '^(.*)/[^/]*$', 1) END AS source, node_id AS target, 'CONTAINS' AS relationship FROM tree WHERE node_type <> 'repository'
  UNION ALL SELECT DISTINCT coalesce(last.node_id, 'file:' || s.repository_id || ':' || s.file_path), s.node_id, 'CONTAINS' FROM s LEFT JOIN last ON (last.repository_id, last.file_path, last.name) = (s.repository_id, s.file_path, s.up)
  UNION ALL SELECT 'file:' || repository_id || ':' || file_path, CASE WHEN target IS NULL THEN 'external:' || repository_id || ':external_module:' || import_text ELSE 'file:' || repository_id || ':' || target END, 'IMPORTS' FROM hits
  UNION ALL SELECT source, coalesce(found, 'external:' || repository_id || ':external_symbol:' || callee), 'CALLS' FROM called
  UNION ALL SELECT source, 'external:' || repository_id || ':external_symbol:' || base, 'INHERITS' FROM heirs
), b AS (SELECT * FROM e UNION ALL SELECT target, source, CASE relationship WHEN 'CONTAINS' THEN 'DEFINED_IN' WHEN 'IMPORTS' THEN 'IMPORTED_BY' ELSE 'CALLED_BY' END FROM e WHERE relationship <> 'INHERITS')
SELECT source, target, relationship, count(*) AS n FROM b GROUP BY 1, 2, 3""",
}
