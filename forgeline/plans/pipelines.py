"""Queries of chunk extraction and of streams."""

from pyspark.sql import functions as F

from forgeline.operators.chunking import extract_chunks
from forgeline.operators.graph import symbol_nodes
from forgeline.session import table, wide_table
from forgeline.streaming import events


def _chunks(spark, sf_dir):
    files = wide_table(spark, sf_dir, "code_chunks").filter("file_id is not null").select("file_id", "repository_id", "file_path", "source_code")
    return extract_chunks(files)


def chunk_extract(spark, sf_dir):
    c = _chunks(spark, sf_dir).select("file_id", "symbol_type", "symbol_name", "parent_symbol", "start_line", "end_line", "chunk_key", "checksum")
    return c.distinct()


def chunk_graph(spark, sf_dir):
    """Symbol nodes of the extracted chunks, with their parents."""
    return symbol_nodes(_chunks(spark, sf_dir).filter("repository_id is not null").dropDuplicates(["repository_id", "file_path", "symbol_name", "start_line"]))


def _stream(spark, sf_dir):
    return events.event_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


def stream_tumbling(spark, sf_dir):
    out = events.run_to_end(events.tumbling_counts(_stream(spark, sf_dir), "ts", "event_type"), "tumbling")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf_dir):
    out = events.run_to_end(events.session_counts(_stream(spark, sf_dir), "ts", "user_id"), "sessions")
    return out.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n_events")


QUERIES = {f.__name__: f for f in (chunk_extract, chunk_graph, stream_tumbling, stream_sessions)}

# a stream closes the windows that end before its watermark: the last event less the time that events may be late
_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"
SQL = {
    "stream_tumbling": f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= {_CLOSED}",
    "stream_sessions": f"""SELECT session_start, session_end, user_id, n_events FROM (
  SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n_events FROM (
    SELECT *, sum(CASE WHEN ts < prev + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
  ) GROUP BY user_id, s
) WHERE session_end <= {_CLOSED}""",
}
