"""Aggregates over repositories: languages, chunks, storage, activity and trees of directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgeline.functions.text import clean_path, normalized_language, path_prefixes


def distinct_files(chunks: DataFrame) -> DataFrame:
    """One row a file with what the aggregates need; rows without an id are left out."""
    return chunks.filter("file_id is not null").groupBy("file_id").agg(
        F.min("repository_id").alias("repository_id"), F.min(clean_path(F.col("file_path"))).alias("file_path"), F.min("language").alias("language"),
        F.min("checksum").alias("checksum"), F.min(F.length("source_code")).alias("n_chars"), F.min(F.octet_length("source_code")).alias("n_bytes"),
        F.min(F.when(F.length("source_code") > 0, F.length("source_code") - F.length(F.replace("source_code", F.lit("\n"), F.lit(""))) + 1).otherwise(0)).alias("n_lines"),
    )


def language_distribution(files: DataFrame) -> DataFrame:
    """``language, n_files, percentage``; the total is a sum over the few languages."""
    by = files.groupBy(normalized_language(F.col("language")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))
    total = by.agg(F.sum("n_files").alias("total"))
    return by.crossJoin(total).select("language", "n_files", F.round(F.col("n_files") / F.col("total") * 100, 6).alias("percentage"))


def language_rollup(files: DataFrame) -> DataFrame:
    """Files and characters by repository and language, by repository, and in all; null stands for all of a level."""
    rows = files.withColumn("language", normalized_language(F.col("language"))).withColumn("repository", F.coalesce("repository_id", F.lit(-1)))
    return rows.rollup("repository", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_chars"))


def chunk_statistics(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``repository_id, n_files, n_lines, source_bytes, average_bytes, longest_file``."""
    return files.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").cast("long").alias("n_lines"), F.sum("n_bytes").cast("long").alias("source_bytes"), F.round(F.avg("n_bytes"), 6).alias("average_bytes"), F.max("n_bytes").cast("long").alias("longest_file")
    )


def storage_breakdown(files: DataFrame, vectors: DataFrame, bytes_per_vector: int = 384 * 4) -> DataFrame:
    """One row: bytes of sources, of embeddings at a fixed size each, of metadata (path and checksum as JSON) and in all."""
    text = F.length(F.concat(F.lit('{"path": "'), F.coalesce("file_path", F.lit("")), F.lit('", "checksum": "'), F.coalesce("checksum", F.lit("")), F.lit('"}')))
    a = files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("source_bytes"), F.coalesce(F.sum(text), F.lit(0)).cast("long").alias("metadata_bytes"))
    b = vectors.agg((F.count(F.lit(1)) * bytes_per_vector).alias("embedding_bytes"))
    return a.crossJoin(b).select("source_bytes", "embedding_bytes", "metadata_bytes", (F.col("source_bytes") + F.col("embedding_bytes") + F.col("metadata_bytes")).alias("total_bytes"))


def activity(log: DataFrame, key: str, at: str, days: int = 90, newest: int = 500) -> DataFrame:
    """``day, n_events`` over the ``newest`` entries of each key within ``days`` of the latest entry of all."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("event_id"))
    last = log.agg(F.max(at).alias("last"))
    recent = log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest).crossJoin(last).filter(F.col(at) >= F.col("last") - F.make_dt_interval(days=F.lit(days)))
    return recent.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n_events"))


def latest_per_key(log: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """``key, {at}, {value}`` of the last entry of each key."""
    last = F.max_by(F.struct(at, value), F.struct(at, tie))
    return log.filter(F.col(key).isNotNull()).groupBy(key).agg(last.alias("l")).select(key, f"l.{at}", f"l.{value}")


def directory_tree(files: DataFrame) -> DataFrame:
    """``repository_id, dir, depth, n_files, n_below``: files directly in and anywhere under each directory."""
    rows = files.filter("repository_id is not null and file_path is not null").select("repository_id", path_prefixes(F.col("file_path")).alias("dirs"))
    steps = rows.select("repository_id", F.size("dirs").alias("n"), F.posexplode("dirs").alias("k", "dir"))
    return steps.groupBy("repository_id", "dir").agg((F.max("k") + 1).cast("long").alias("depth"), F.count(F.when(F.col("k") == F.col("n") - 1, 1)).alias("n_files"), F.count(F.lit(1)).alias("n_below"))


def visible_tree(tree: DataFrame, expanded: DataFrame) -> DataFrame:
    """The directories of which all ancestors are expanded. ``expanded`` has ``repository_id, dir``."""
    above = tree.select("repository_id", "dir", F.explode_outer(path_prefixes(F.col("dir"))).alias("up"))
    open_ = expanded.select("repository_id", F.col("dir").alias("up"), F.lit(1).alias("is_open")).distinct()
    shut = above.filter("up is not null").join(open_, ["repository_id", "up"], "left").filter("is_open is null").select("repository_id", "dir").distinct()
    return tree.join(shut, ["repository_id", "dir"], "left_anti")


def matching_lines(df: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """``key, line_no, line`` of lines that hold the needle in any case; one line end at the end of a text is no line.

    Texts without the needle are left out before they are split."""
    if not needle.strip():
        return df.select(key, F.lit(0).cast("long").alias("line_no"), F.lit("").alias("line")).limit(0)
    low = needle.strip().lower()
    lines = F.split(F.regexp_replace(F.col(text), "\n$", ""), "\n")
    rows = df.filter(F.lower(F.col(text)).contains(low)).select(key, F.posexplode(lines).alias("k", "line"))
    return rows.filter(F.lower("line").contains(low)).select(key, (F.col("k") + 1).cast("long").alias("line_no"), "line")
