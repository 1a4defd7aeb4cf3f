"""Queries of the catalogue, analytics, texts and logs."""

from pyspark.sql import functions as F

from forgeline.functions import text as T
from forgeline.operators import analytics, catalog, records
from forgeline.session import table


def _files(spark, sf_dir):
    return analytics.distinct_files(table(spark, sf_dir, "code_chunks"))


def language_distribution(spark, sf_dir):
    return analytics.language_distribution(_files(spark, sf_dir))


def language_rollup(spark, sf_dir):
    return analytics.language_rollup(_files(spark, sf_dir))


def chunk_statistics(spark, sf_dir):
    return analytics.chunk_statistics(_files(spark, sf_dir))


def storage_breakdown(spark, sf_dir):
    return analytics.storage_breakdown(_files(spark, sf_dir), table(spark, sf_dir, "embeddings"))


def commit_activity(spark, sf_dir):
    return analytics.activity(table(spark, sf_dir, "events"), "user_id", "ts")


def latest_event(spark, sf_dir):
    return analytics.latest_per_key(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


def event_properties(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.count(k).alias("n_with_k"), F.sum(k).alias("sum_k"), F.round(F.sum("value"), 4).alias("sum_value"))


def file_tree(spark, sf_dir):
    return analytics.directory_tree(_files(spark, sf_dir))


def line_search(spark, sf_dir):
    return analytics.matching_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "Heartbeat")


def text_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.contains(F.col("text"), " Registry ")).select("doc_id", "source")


def token_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


def chunk_keys(spark, sf_dir):
    c = table(spark, sf_dir, "code_chunks").filter("file_id is not null and repository_id is not null and file_path is not null")
    key = T.chunk_key(F.col("repository_id"), T.clean_path(F.col("file_path")), F.col("parent_symbol"), F.col("symbol_name"), F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)))
    return c.select("file_id", key.alias("chunk_key"), F.sha2(F.coalesce("source_code", F.lit("")), 256).alias("digest")).distinct()


def latest_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "code_chunks").filter("file_id is not null")
    return catalog.latest_rows(c.select("file_id", "ingested_at", "chunk_id"), ["file_id"], "ingested_at")


def files_page(spark, sf_dir):
    files = catalog.files_with_repository(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "repositories"))
    return catalog.page(files, [F.col("repository_name"), F.col("file_path"), F.col("file_id")], 500, 100)


def files_catalogue(spark, sf_dir):
    return catalog.files_with_repository(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "repositories"))


def repository_counters(spark, sf_dir):
    return catalog.counters(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "repositories"))


def repository_status(spark, sf_dir):
    return catalog.status_counts(table(spark, sf_dir, "repositories"))


def repository_identity(spark, sf_dir):
    r = table(spark, sf_dir, "repositories").select("id", T.repository_identity(F.col("repository_url")).alias("i")).distinct()
    return r.select("id", "i.host", "i.owner", "i.name")


def recent_responses(spark, sf_dir):
    r = table(spark, sf_dir, "query_responses").select("response_id", "created_at", "query").distinct()
    return catalog.page(r, [F.desc("created_at"), F.col("response_id")], 20)


def citations(spark, sf_dir):
    return catalog.valid_citations(table(spark, sf_dir, "query_responses"))


def response_usage(spark, sf_dir):
    r = table(spark, sf_dir, "query_responses").filter("response_id is not null").groupBy("response_id").agg(F.min("model").alias("model"), F.min("latency_seconds").alias("latency"), F.min("token_usage.total_tokens").alias("tokens"))
    return r.groupBy("model").agg(F.count(F.lit(1)).alias("n_responses"), F.sum("tokens").alias("total_tokens"), F.round(F.avg("latency"), 6).alias("average_latency"), F.round(F.max("latency"), 6).alias("longest"))


def path_safety(spark, sf_dir):
    p = F.col("file_path")
    return table(spark, sf_dir, "code_chunks").filter("file_id is not null").select("file_id", T.is_safe_path(p).alias("safe"), T.is_protected_path(p).alias("protected"), T.language_label(F.col("language")).alias("label")).distinct()


def inspection_manifest(spark, sf_dir):
    """Path and hash of the files that may be shown: not protected and at most a mebibyte."""
    c = table(spark, sf_dir, "code_chunks").filter("file_id is not null and source_code is not null")
    shown = c.filter(~T.is_protected_path(F.col("file_path")) & (F.octet_length("source_code") <= 1 << 20))
    return shown.select("file_id", F.concat(T.clean_path(F.col("file_path")), F.lit(" sha256="), F.sha2("source_code", 256)).alias("entry")).distinct()


def storage_roundtrip(spark, sf_dir):
    """The chunks as vector records, flattened for storage and read back."""
    c = table(spark, sf_dir, "code_chunks").filter("file_id is not null")
    meta = F.map_from_entries(F.array(F.struct(F.lit("checksum").alias("k"), F.coalesce("checksum", F.lit("none")).alias("v")), F.struct(F.lit("code").alias("k"), F.lit("other").alias("v"))))
    r = c.select("chunk_id", "file_id", "repository_id", "file_path", "language", "symbol_type", "symbol_name", F.when(F.col("start_line") >= 0, F.col("start_line")).alias("start_line"), F.when(F.col("end_line") >= 0, F.col("end_line")).alias("end_line"), F.col("source_code").alias("code"), meta.alias("metadata"))
    back = records.from_storage(records.to_storage(r))
    return back.select("file_id", "chunk_id", "symbol_type", "symbol_name", "start_line", "end_line", F.length("code").alias("n_chars"), F.col("metadata")["checksum"].alias("checksum"), F.size("metadata").alias("n_keys")).distinct()


def document_embeddings(spark, sf_dir):
    d, _ = records.blank_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return d.select("doc_id", records.hashed_embedding()(F.col("text")).alias("embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        language_distribution, language_rollup, chunk_statistics, storage_breakdown, commit_activity, latest_event, event_properties, file_tree, line_search, text_contains, token_estimate, chunk_keys,
        latest_chunks, files_page, files_catalogue, repository_counters, repository_status, repository_identity, recent_responses, citations, response_usage, path_safety, inspection_manifest, storage_roundtrip, document_embeddings,
    )
}

_CLEAN = "regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '')"
_LANG = "(CASE WHEN coalesce(length(lower(trim(string_split({c}, '.')[-1]))), 0) = 0 THEN 'unknown' ELSE coalesce(map {{'py': 'python', 'js': 'javascript', 'ts': 'typescript'}}[lower(trim(string_split({c}, '.')[-1]))], lower(trim(string_split({c}, '.')[-1]))) END)"
_FILES = f"""WITH f AS (
  SELECT file_id, min(repository_id) AS repository_id, min({_CLEAN}) AS file_path, min(language) AS language, min(checksum) AS checksum, min(length(source_code)) AS n_chars, min(strlen(source_code)) AS n_bytes,
         min(CASE WHEN length(source_code) > 0 THEN length(source_code) - length(replace(source_code, chr(10), '')) + 1 ELSE 0 END) AS n_lines
  FROM code_chunks WHERE file_id IS NOT NULL GROUP BY file_id
)"""
_NAMED = f"SELECT c.repository_id, r.repository_name, c.file_id, c.file_path, {_LANG.format(c='c.language')} AS language FROM f c JOIN (SELECT id, min(repository_name) AS repository_name FROM repositories GROUP BY id) r ON r.id = c.repository_id"
_URL = "^(?:https?://|git@|ssh://git@)?(?:www\\.)?([\\w.-]+)[/:]([\\w.-]+)/([\\w.-]+?)(?:\\.git)?/?$"

SQL = {
    "inspection_manifest": f"SELECT DISTINCT file_id, {_CLEAN} || ' sha256=' || sha256(source_code) AS entry FROM code_chunks WHERE file_id IS NOT NULL AND source_code IS NOT NULL AND strlen(source_code) <= 1048576 AND NOT regexp_matches(lower({_CLEAN}), '(?:^|/)(?:\\.env[^/]*|credentials[^/]*|secrets[^/]*|[^/]*\\.(?:pem|key))$|(?:^|/)\\.git/')",
    "storage_roundtrip": "SELECT DISTINCT file_id, chunk_id, nullif(symbol_type, '') AS symbol_type, nullif(symbol_name, '') AS symbol_name, CASE WHEN start_line >= 0 THEN start_line END AS start_line, CASE WHEN end_line >= 0 THEN end_line END AS end_line, length(source_code) AS n_chars, coalesce(checksum, 'none') AS checksum, 1 AS n_keys FROM code_chunks WHERE file_id IS NOT NULL",
    "language_distribution": f"{_FILES} SELECT {_LANG.format(c='language')} AS language, count(*) AS n_files, round(count(*) / (SELECT count(*) FROM f) * 100, 6) AS percentage FROM f GROUP BY 1",
    "language_rollup": f"{_FILES} SELECT repository, language, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (SELECT coalesce(repository_id, -1) AS repository, {_LANG.format(c='language')} AS language, n_chars FROM f) GROUP BY ROLLUP (repository, language)",
    "chunk_statistics": f"{_FILES} SELECT repository_id, count(*) AS n_files, CAST(sum(n_lines) AS BIGINT) AS n_lines, CAST(sum(n_bytes) AS BIGINT) AS source_bytes, round(avg(n_bytes), 6) AS average_bytes, CAST(max(n_bytes) AS BIGINT) AS longest_file FROM f GROUP BY repository_id",
    "storage_breakdown": f"""{_FILES}, a AS (SELECT CAST(sum(n_bytes) AS BIGINT) AS source_bytes, CAST(sum(length('{{"path": "' || coalesce(file_path, '') || '", "checksum": "' || coalesce(checksum, '') || '"}}')) AS BIGINT) AS metadata_bytes FROM f)
SELECT source_bytes, (SELECT count(*) * 1536 FROM embeddings) AS embedding_bytes, metadata_bytes, source_bytes + metadata_bytes + (SELECT count(*) * 1536 FROM embeddings) AS total_bytes FROM a""",
    "commit_activity": "SELECT CAST(ts AS DATE) AS day, count(*) AS n_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 500 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAY GROUP BY 1",
    "latest_event": "SELECT user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "event_properties": "SELECT event_type, count(*) AS n_events, count(json_extract(props, '$.k')) AS n_with_k, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, round(sum(value), 4) AS sum_value FROM events GROUP BY event_type",
    "file_tree": f"""{_FILES}, p AS (SELECT repository_id, string_split(file_path, '/') AS p FROM f WHERE repository_id IS NOT NULL AND file_path IS NOT NULL), s AS (SELECT repository_id, p, unnest(range(1, len(p))) AS k FROM p)
SELECT repository_id, array_to_string(p[:k], '/') AS dir, CAST(max(k) AS BIGINT) AS depth, count(*) FILTER (WHERE k = len(p) - 1) AS n_files, count(*) AS n_below FROM s GROUP BY 1, 2""",
    "line_search": "SELECT doc_id, CAST(k AS BIGINT) AS line_no, l[k] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE contains(lower(l[k]), 'heartbeat')",
    "text_contains": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'registry')",
    "token_estimate": "SELECT source, count(*) AS n_documents, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source",
    "chunk_keys": f"""SELECT DISTINCT file_id, left(sha256(repository_id || ':' || {_CLEAN} || ':' || CASE WHEN coalesce(parent_symbol, '') <> '' THEN parent_symbol || '.' ELSE '' END || coalesce(symbol_name, '') || ':' || coalesce(start_line, 0) || '-' || coalesce(end_line, 0)), 16) AS chunk_key,
sha256(coalesce(source_code, '')) AS digest FROM code_chunks WHERE file_id IS NOT NULL AND repository_id IS NOT NULL AND file_path IS NOT NULL""",
    "latest_chunks": "SELECT file_id, max(ingested_at) AS ingested_at, arg_max(chunk_id, ingested_at) AS chunk_id FROM code_chunks WHERE file_id IS NOT NULL GROUP BY file_id",
    "files_page": f"{_FILES} SELECT * FROM ({_NAMED}) ORDER BY repository_name, file_path, file_id LIMIT 500 OFFSET 100",
    "files_catalogue": f"{_FILES} {_NAMED}",
    "repository_counters": "SELECT r.id, CAST(r.total_files AS BIGINT) AS total_files, coalesce(n, 0) AS n_files, coalesce(n, 0) - r.total_files AS difference FROM (SELECT id, max(total_files) AS total_files FROM repositories GROUP BY id) r LEFT JOIN (SELECT repository_id, count(DISTINCT file_id) AS n FROM code_chunks WHERE file_id IS NOT NULL GROUP BY 1) c ON c.repository_id = r.id",
    "repository_status": "SELECT indexing_status, count(*) AS n_repositories FROM (SELECT id, arg_max(indexing_status, updated_at) AS indexing_status FROM repositories GROUP BY id) GROUP BY 1",
    "repository_identity": f"SELECT DISTINCT id, nullif(regexp_extract(lower(trim(repository_url)), '{_URL}', 1), '') AS host, nullif(regexp_extract(lower(trim(repository_url)), '{_URL}', 2), '') AS owner, nullif(regexp_extract(lower(trim(repository_url)), '{_URL}', 3), '') AS name FROM repositories",
    "recent_responses": "SELECT DISTINCT response_id, created_at, query FROM query_responses ORDER BY created_at DESC, response_id LIMIT 20",
    "citations": "SELECT response_id, CAST(k - 1 AS BIGINT) AS position, c[k].file_path AS file_path, c[k].start_line AS start_line, c[k].end_line AS end_line, c[k].symbol_name AS symbol_name FROM (SELECT response_id, c, unnest(range(1, len(c) + 1)) AS k FROM (SELECT response_id, first(citations) AS c FROM query_responses WHERE response_id IS NOT NULL GROUP BY 1)) WHERE c[k].start_line >= 1 AND c[k].end_line >= c[k].start_line",
    "response_usage": "SELECT model, count(*) AS n_responses, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(avg(latency), 6) AS average_latency, round(max(latency), 6) AS longest FROM (SELECT response_id, min(model) AS model, min(latency_seconds) AS latency, min(token_usage.total_tokens) AS tokens FROM query_responses WHERE response_id IS NOT NULL GROUP BY 1) GROUP BY model",
    "path_safety": f"""SELECT DISTINCT file_id, length(file_path) > 0 AND NOT regexp_matches(replace(file_path, '\\', '/'), '\\x00|^/|^[A-Za-z]:|(?:^|/)\\.\\.(?:/|$)') AS safe,
regexp_matches(lower({_CLEAN}), '(?:^|/)(?:\\.env[^/]*|credentials[^/]*|secrets[^/]*|[^/]*\\.(?:pem|key))$|(?:^|/)\\.git/') AS protected,
CASE WHEN {_LANG.format(c='language')} = 'unknown' THEN 'Unknown language' ELSE coalesce(map {{'python': 'Python', 'javascript': 'JavaScript', 'typescript': 'TypeScript', 'json': 'JSON', 'yaml': 'YAML', 'toml': 'TOML'}}[{_LANG.format(c='language')}], upper({_LANG.format(c='language')}[1]) || {_LANG.format(c='language')}[2:]) END AS label
FROM code_chunks WHERE file_id IS NOT NULL""",
}
