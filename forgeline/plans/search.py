"""Queries of search and retrieval: every vector whose id is divisible by 100 asks all vectors."""

from pyspark.sql import functions as F

from forgeline.operators import retrieval
from forgeline.operators.vectors import fitted_cells, nearest, nearest_in_cells, probes_needed, recall
from forgeline.session import table

K = 15


def _asking(v):
    return v.filter("vec_id % 100 = 0")


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def knn_batch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _round(nearest(v, _asking(v), K), "distance", "similarity")


def knn_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _round(nearest(v.filter("label = 1"), _asking(v), 5), "distance", "similarity")


def knn_post_filter(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _round(nearest(v, _asking(v), K).join(v.select("vec_id", "label"), "vec_id").filter("label = 1"), "distance", "similarity")


def knn_threshold(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return _round(nearest(v, _asking(v), K).filter("similarity >= 0.02"), "distance", "similarity")


def _by_index(v):
    centres = fitted_cells(v)
    return nearest_in_cells(v, _asking(v), centres, K, probes_needed(v, centres, K))


def knn_indexed(spark, sf_dir):
    return _round(_by_index(table(spark, sf_dir, "embeddings")), "distance", "similarity")


def knn_recall(spark, sf_dir):
    """How much of the exact search the index finds; the check against brute force."""
    v = table(spark, sf_dir, "embeddings")
    return recall(_by_index(v), nearest(v, _asking(v), K))


def knn_by_text(spark, sf_dir):
    """Keys of text, as chunks have them."""
    v = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.concat(F.lit("chunk-"), F.col("vec_id").cast("string")))
    return _round(nearest(v, v.filter("vec_id like '%00' or vec_id = 'chunk-0'"), K), "distance", "similarity")


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("vec_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("code"), F.col("file_path"), F.col("source").alias("symbol_name"))


def _ranked(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    r = _records(spark, sf_dir)
    asked = _asking(v).join(r.select("vec_id", F.concat_ws(" ", "symbol_name", "file_path").alias("query_text")), "vec_id")
    return retrieval.retrieve(v, r, asked, top_k=5, threshold=0.001)


def retrieval_ranked(spark, sf_dir):
    return _round(_ranked(spark, sf_dir).select("query_id", "chunk_id", "similarity", "rank_score", "rank"), "similarity", "rank_score")


def retrieval_packed(spark, sf_dir):
    packed = retrieval.pack(_ranked(spark, sf_dir), 400)
    return packed.select("query_id", "tokens", "truncated", F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.transform("chunks", lambda c: c["chunk_id"]), ",").alias("chunk_ids"))


def retrieval_context(spark, sf_dir):
    return retrieval.render(retrieval.pack(_ranked(spark, sf_dir), 400))


QUERIES = {f.__name__: f for f in (knn_batch, knn_filtered, knn_post_filter, knn_threshold, knn_indexed, knn_recall, knn_by_text, retrieval_ranked, retrieval_packed, retrieval_context)}

_DIST = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))"


def _near(k, where="true"):
    return f"""
SELECT query_id, vec_id, distance, 1 / (1 + distance) AS similarity, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS rank
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND {where}
) WHERE rank <= {k}"""


_ROUNDED = "query_id, vec_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity, rank"


def _terms(x):
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '::|[_\\-/.()]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1))"


_RANKED = f"""
WITH RECURSIVE near AS ({_near(15)}), r AS (
  SELECT doc_id AS vec_id, doc_id AS chunk_id, text AS code, file_path, source AS symbol_name FROM documents
), rows AS (
  SELECT n.query_id, r.chunk_id, n.similarity, n.rank AS candidate, r.code, r.file_path,
         n.similarity + 0.05 * len(list_intersect({_terms("concat_ws(' ', a.symbol_name, a.file_path)")}, list_concat({_terms("coalesce(r.symbol_name, '')")}, {_terms("coalesce(r.file_path, '')")}))) AS rank_score
  FROM near n JOIN r ON r.vec_id = n.vec_id JOIN r a ON a.vec_id = n.query_id
  WHERE length(regexp_replace(r.code, '\\s+', '', 'g')) > 0 AND n.similarity >= 0.001
), ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, candidate) AS rank FROM rows) WHERE rank <= 5
)"""
_PACKED = (
    _RANKED
    + """, sized AS (SELECT *, greatest(1, length(code) // 4) AS n FROM ranked), fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS used, false AS cut, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS parts FROM sized WHERE rank = 1
  UNION ALL
  SELECT f.query_id, s.rank, CASE WHEN f.used + s.n <= 400 THEN f.used + s.n ELSE f.used END, f.cut OR f.used + s.n > 400,
         CASE WHEN f.used + s.n <= 400 THEN list_append(f.ids, CAST(s.chunk_id AS VARCHAR)) ELSE f.ids END,
         CASE WHEN f.used + s.n <= 400 THEN list_append(f.parts, 'File: ' || coalesce(s.file_path, '') || chr(10) || chr(10) || substring(s.code, 1, 800)) ELSE f.parts END
  FROM fold f JOIN sized s ON s.query_id = f.query_id AND s.rank = f.pos + 1
), done AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY query_id) AS final FROM fold) WHERE pos = final)
"""
)

SQL = {
    "knn_batch": f"SELECT {_ROUNDED} FROM ({_near(K)})",
    "knn_by_text": f"SELECT * REPLACE ('chunk-' || query_id AS query_id, 'chunk-' || vec_id AS vec_id) FROM (SELECT {_ROUNDED} FROM ({_near(K)}))",
    "knn_filtered": f"SELECT {_ROUNDED} FROM ({_near(5, 'v.label = 1')})",
    "knn_post_filter": f"SELECT {_ROUNDED}, label FROM ({_near(K)}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WHERE label = 1",
    "knn_threshold": f"SELECT {_ROUNDED} FROM ({_near(K)}) WHERE similarity >= 0.02",
    "retrieval_ranked": _RANKED + "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, round(rank_score, 6) AS rank_score, rank FROM ranked",
    "retrieval_packed": _PACKED + "SELECT query_id, CAST(used AS BIGINT) AS tokens, cut AS truncated, CAST(len(ids) AS BIGINT) AS n_chunks, array_to_string(ids, ',') AS chunk_ids FROM done",
    "retrieval_context": _PACKED + "SELECT query_id, chr(10) || chr(10) || array_to_string(parts, chr(10) || chr(10) || repeat('-', 80) || chr(10) || chr(10)) AS context FROM done",
}
