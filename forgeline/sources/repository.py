"""Files of a checked-out repository as tables: listing with pruned directories, size guard, and contents."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from forgeline.functions.text import PARSED_EXTENSIONS, base_name, is_safe_path, lookup, path_extension
from forgeline.session import materialize_counted, read_together

# Directories that are never looked into.
IGNORED = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".idea")
MAX_BYTES = 1 << 20
#: Files whose contents a task holds at once.
FILES_AT_ONCE = 32


def _address(root: str) -> str:
    """``root`` as an address; a plain path is one of a file system that all executors see."""
    return root.rstrip("/") if "://" in root else "file://" + quote(root.rstrip("/"))


def _listing(folders: DataFrame, base: str) -> DataFrame:
    """``path, is_dir, n_bytes, modified_at`` of what lies directly in each folder ``path`` below ``base``, listed in
    tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(base)
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                for x in system.get_file_info(fs.FileSelector(f"{inner.rstrip('/')}/{folder}")):
                    rows.append((f"{folder}{x.base_name}{'/' if x.type == fs.FileType.Directory else ''}", x.type == fs.FileType.Directory, x.size, x.mtime))
            yield pd.DataFrame(rows, columns=["path", "is_dir", "n_bytes", "modified_at"]).astype({"n_bytes": "Int64"})

    return folders.mapInPandas(run, "path string, is_dir boolean, n_bytes long, modified_at timestamp")


def listed_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """``file_path, n_bytes, modified_at`` below ``root``, a folder of a shared file system; contents are not read.

    Folders are listed level by level, a level's folders side by side in tasks, and ignored ones are not entered.
    Names that begin with a dot or an underscore are listed like all others.
    """
    folders, n = spark.createDataFrame([("",)], "path string"), 1
    levels: list[DataFrame] = []
    while n:
        found = _listing(folders.repartition(spark.sparkContext.defaultParallelism, "path"), _address(root))
        kept = found.filter(~F.col("is_dir") | ~base_name(F.rtrim("path", F.lit("/"))).isin(*ignored))
        level, n = materialize_counted(kept, "listing", F.col("is_dir"))
        levels.append(level)
        folders = level.filter("is_dir").select("path")
    return read_together(levels).filter("not is_dir").select(F.col("path").alias("file_path"), "n_bytes", "modified_at")


def parse_plan(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files with ``language`` and ``outcome``: ``parse``, or ``skip`` for other extensions and larger files.
    A file of exactly ``max_bytes`` is parsed."""
    language = lookup(PARSED_EXTENSIONS, path_extension(F.col("file_path")))
    fits: Column = F.col("n_bytes") <= max_bytes
    return files.withColumn("language", language).withColumn("outcome", F.when(language.isNotNull() & fits, "parse").otherwise("skip"))


def read_sources(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """``file_path, language, n_bytes, checksum, source_code`` of the files to parse. The size is known from the
    listing, so larger files are never read; bytes that are no UTF-8 become U+FFFD."""
    base = _address(root)
    plan = parse_plan(listed_files(spark, root, ignored), max_bytes).filter("outcome = 'parse'").select("file_path", "language", "n_bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(base)
        for batch in batches:
            for at in range(0, len(batch), FILES_AT_ONCE):
                part = batch.iloc[at : at + FILES_AT_ONCE]
                contents = []
                for path in part["file_path"]:
                    with system.open_input_stream(f"{inner.rstrip('/')}/{path}") as f:
                        contents.append(f.read())
                yield part.assign(content=contents)

    read = plan.repartition(spark.sparkContext.defaultParallelism, "file_path").mapInPandas(run, StructType([*plan.schema.fields, StructField("content", BinaryType())]))
    return read.select("file_path", "language", "n_bytes", F.sha2("content", 256).alias("checksum"), F.expr("make_valid_utf8(string(content))").alias("source_code"))


def run_summary(plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row ``files_parsed, files_skipped, files_failed``; ``failed`` has the ``file_path`` of files that broke."""
    rows = plan
    if failed is not None:
        rows = plan.join(failed.select("file_path").distinct().withColumn("_f", F.lit(True)), "file_path", "left")
    broke = F.coalesce(F.col("_f"), F.lit(False)) if failed is not None else F.lit(False)
    return rows.agg(
        F.count(F.when((F.col("outcome") == "parse") & ~broke, 1)).alias("files_parsed"), F.count(F.when(F.col("outcome") == "skip", 1)).alias("files_skipped"), F.count(F.when((F.col("outcome") == "parse") & broke, 1)).alias("files_failed")
    )


def file_content(files: DataFrame, path: str) -> DataFrame:
    """The one file of a path, after the path has been found safe."""
    row = files.sparkSession.range(1).select(is_safe_path(F.lit(path)).alias("ok")).first()
    if not row["ok"]:
        raise ValueError(f"not a path inside the repository: {path!r}")
    return files.filter(F.col("file_path") == path.replace("\\", "/"))


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each ``file_path, source_code`` below ``root`` in tasks, and give ``file_path, n_bytes`` of what was written."""
    base = _address(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(base)
        for batch in batches:
            sizes = []
            for path, source in zip(batch["file_path"], batch["source_code"]):
                target = f"{inner.rstrip('/')}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                data = source.encode("utf-8")
                with system.open_output_stream(target) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"file_path": batch["file_path"], "n_bytes": sizes})

    return files.select("file_path", "source_code").mapInPandas(run, "file_path string, n_bytes long")
