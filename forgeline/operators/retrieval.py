"""The retrieval pipeline: search, filters, de-duplication, lexical ranking, budget and context, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.functions.text import estimate_tokens, is_protected_path, is_safe_path, lexical_bonus
from forgeline.operators.vectors import nearest

POOL_FACTOR, POOL_LIMIT, TOP_K, TOKEN_BUDGET = 3, 200, 5, 1200


def pool_size(top_k: int) -> int:
    return min(POOL_FACTOR * top_k, POOL_LIMIT)


def resolved(requested: int | None, default: int) -> int:
    """The requested number, or the default where it is null or not positive."""
    return requested if requested is not None and requested > 0 else default


def keep_best(df: DataFrame, group: list[str], key: str, score: str, order: list[Column]) -> DataFrame:
    """Of rows with one key in a group the one with the highest score, the first of equals in ``order``."""
    w = Window.partitionBy(*group, key).orderBy(F.desc(score), *order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def retrieve(
    vectors: DataFrame, records: DataFrame, queries: DataFrame, top_k: int | None = None, threshold: float | None = None, path: str | None = None, where: Column | None = None
) -> DataFrame:
    """``query_id, chunk_id, similarity, rank_score, rank, code, file_path, symbol_name`` of the best chunks of each query.

    ``vectors`` and ``queries`` have ``vec_id, embedding``, queries also ``query_text``; ``records`` has ``vec_id,
    chunk_id, code, file_path, symbol_name``. The order is that of a retrieval service: ``where`` restricts the
    records before the pool of candidates is cut; then chunks with blank code go, copies of a chunk, other paths
    than ``path``, what is less similar than ``threshold``; the rest is ranked by similarity and shared terms and cut
    to ``top_k``. As filters come after the cut, a query may get fewer rows. Ties go to the earlier candidate.
    """
    k = resolved(top_k, TOP_K)
    if where is not None:
        vectors = vectors.join(records.filter(where).select("vec_id").distinct(), "vec_id", "left_semi")
    pool = nearest(vectors, queries, pool_size(k)).withColumnRenamed("rank", "candidate")
    rows = pool.join(records.select("vec_id", "chunk_id", "code", "file_path", "symbol_name"), "vec_id").filter(F.length(F.regexp_replace("code", r"\s+", "")) > 0)
    rows = keep_best(rows, ["query_id"], "chunk_id", "similarity", [F.col("candidate")])
    if path is not None:
        rows = rows.filter(F.col("file_path") == path)
    if threshold is not None:
        rows = rows.filter(F.col("similarity") >= threshold)
    asked = queries.select(F.col("vec_id").alias("query_id"), "query_text")
    scored = rows.join(asked, "query_id").withColumn("rank_score", F.col("similarity") + lexical_bonus(F.coalesce("query_text", F.lit("")), F.col("symbol_name"), F.col("file_path")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "candidate"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "chunk_id", "similarity", "rank_score", "rank", "code", "file_path", "symbol_name")


def pack(ranked: DataFrame, budget: int | None = None) -> DataFrame:
    """``query_id, tokens, truncated, chunks`` after greedy packing: in rank order what fits is taken, what does not is
    skipped and the rest still tried. At most ``top_k`` rows a query are folded, so no group grows with the data."""
    limit = resolved(budget, TOKEN_BUDGET)
    item = F.struct("rank", "chunk_id", "file_path", "code", estimate_tokens(F.col("code")).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("cut"), F.array().cast("array<struct<rank:long,chunk_id:string,file_path:string,code:string,n:long>>").alias("taken"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["n"] <= limit
        return F.struct(
            F.when(fits, state["used"] + x["n"]).otherwise(state["used"]).alias("used"),
            (state["cut"] | ~fits).alias("cut"),
            F.when(fits, F.concat(state["taken"], F.array(x))).otherwise(state["taken"]).alias("taken"),
        )

    rows = ranked.select("query_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "file_path", "code")
    folded = rows.groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("s"))
    return folded.select("query_id", F.col("s.used").alias("tokens"), F.col("s.cut").alias("truncated"), F.col("s.taken").alias("chunks"))


def render(packed: DataFrame, width: int = 800) -> DataFrame:
    """``query_id, context``: an empty line, then the packed chunks as sections with their path and at most ``width``
    letters of code."""
    part = lambda x: F.concat(F.lit("File: "), F.coalesce(x["file_path"], F.lit("")), F.lit("\n\n"), F.substring(x["code"], 1, width))
    return packed.select("query_id", F.concat(F.lit("\n\n"), F.array_join(F.transform("chunks", part), "\n\n" + "-" * 80 + "\n\n")).alias("context"))


def citations(ranked: DataFrame, records: DataFrame) -> DataFrame:
    """``query_id, rank, repository_id, file_path, symbol_name, start_line, end_line, extra`` of ranked chunks: where
    they lie, and what else is told of them, as text."""
    where = records.groupBy("chunk_id").agg(F.max_by(F.struct("repository_id", "start_line", "end_line", "metadata"), F.struct("start_line", "end_line", "repository_id")).alias("r"))
    return ranked.join(where, "chunk_id").select("query_id", "rank", "r.repository_id", "file_path", "symbol_name", "r.start_line", "r.end_line", told_metadata(F.col("r.metadata")).alias("extra"))


def told_metadata(metadata: Column) -> Column:
    """All entries but the code as text: ``True`` and ``False`` with capitals, ``None`` for a missing value."""
    kept = F.map_filter(metadata, lambda k, _: k != "code")
    return F.transform_values(kept, lambda _, v: F.when(v.isNull(), "None").when(v == "true", "True").when(v == "false", "False").otherwise(v))


def sanitised(packed_chunks: DataFrame, path: str = "file_path") -> DataFrame:
    """Chunks of a context without those of protected or unsafe files."""
    return packed_chunks.filter(is_safe_path(F.col(path)) & ~is_protected_path(F.col(path)))
