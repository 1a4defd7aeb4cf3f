"""The relational side: repositories, files, histories, and tables that are published in generations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions.text import clean_path, normalized_language


def latest_rows(df: DataFrame, key: list[str], newest: str) -> DataFrame:
    """Of rows with one key the newest; null times are the oldest, and of equal times the row that sorts last."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(newest).isNotNull(), newest, *[F.to_json(F.struct(c)) for c in rest if c != newest]))
    return df.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*").select(*df.columns)


def tenant(df: DataFrame, workspace_id: str, column: str = "workspace_id") -> DataFrame:
    """The rows of a workspace. It has to be named; rows without one belong to nobody."""
    if not workspace_id:
        raise ValueError("a workspace is required")
    return df.filter(F.col(column) == workspace_id)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def files_with_repository(files: DataFrame, repositories: DataFrame) -> DataFrame:
    """``repository_id, repository_name, file_id, file_path, language`` of files in known repositories, each once."""
    names = repositories.groupBy("id").agg(F.min("repository_name").alias("repository_name"))
    once = files.filter("file_id is not null").groupBy("file_id").agg(F.min("repository_id").alias("repository_id"), F.min(clean_path(F.col("file_path"))).alias("file_path"), F.min("language").alias("language"))
    return once.join(names, once["repository_id"] == names["id"]).select("repository_id", "repository_name", "file_id", "file_path", normalized_language(F.col("language")).alias("language"))


def counters(files: DataFrame, repositories: DataFrame) -> DataFrame:
    """Each repository's stated number of files beside the number there is: ``id, total_files, n_files, difference``."""
    n = files.filter("file_id is not null").groupBy("repository_id").agg(F.countDistinct("file_id").alias("n"))
    r = repositories.groupBy("id").agg(F.max("total_files").cast("long").alias("total_files"))
    return r.join(n, r["id"] == n["repository_id"], "left").select("id", "total_files", F.coalesce("n", F.lit(0)).alias("n_files"), (F.coalesce("n", F.lit(0)) - F.col("total_files")).alias("difference"))


def status_counts(repositories: DataFrame) -> DataFrame:
    """Repositories by status, an open set of words; null is a status of its own."""
    return repositories.groupBy("id").agg(F.max_by("indexing_status", "updated_at").alias("indexing_status")).groupBy("indexing_status").agg(F.count(F.lit(1)).alias("n_repositories"))


def valid_citations(responses: DataFrame) -> DataFrame:
    """``response_id, position, file_path, start_line, end_line, symbol_name`` of citations with a possible line range."""
    once = responses.filter("response_id is not null").groupBy("response_id").agg(F.max_by("citations", F.to_json("citations")).alias("citations"))
    rows = once.select("response_id", F.posexplode("citations").alias("position", "c")).filter("c.start_line >= 1 and c.end_line >= c.start_line")
    return rows.select("response_id", F.col("position").cast("long").alias("position"), "c.file_path", "c.start_line", "c.end_line", "c.symbol_name")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows with those of ``new`` in their place; of new rows with one key the one that sorts last is kept."""
    rest = [c for c in new.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.array(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in rest]))
    fresh = new.groupBy(*key).agg(last.alias("_row")).select(*key, "_row.*").select(*new.columns) if rest else new.distinct()
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition does not hold, those for which it is null among them."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_cascade(parents: DataFrame, key: Column, children: dict[str, tuple[DataFrame, str]], parent_key: str = "id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The parents without those the condition names, and the children without theirs."""
    gone = parents.filter(F.coalesce(key, F.lit(False))).select(F.col(parent_key).alias("_gone")).distinct()
    return delete_where(parents, key), {name: df.join(gone, df[column] == gone["_gone"], "left_anti") for name, (df, column) in children.items()}


def import_decisions(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """``workspace_id, url, decision``: ``create`` for new addresses of a workspace, ``known`` for others."""
    known = repositories.select("workspace_id", F.col("repository_url").alias("url")).distinct().withColumn("here", F.lit(True))
    return requests.distinct().join(known, ["workspace_id", "url"], "left").select("workspace_id", "url", F.when(F.col("here"), "known").otherwise("create").alias("decision"))


def changed_files(before: DataFrame, after: DataFrame, key: str = "file_path", checksum: str = "checksum") -> DataFrame:
    """``key, change`` between two snapshots: ``added``, ``removed`` or ``modified``."""
    a, b = before.select(key, F.col(checksum).alias("_a"), F.lit(1).alias("_old")), after.select(key, F.col(checksum).alias("_b"), F.lit(1).alias("_new"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select(key, change.alias("change")).filter("change is not null")


class Generations:
    """A table directory whose readers see one complete generation: a new one is staged beside it and published by
    creating a pointer file of the next number, which no two writers can create. The highest pointer to a complete
    generation holds, so at no time is there no table; older pointers and generations are dropped afterwards."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def stage(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        name = uuid.uuid4().hex
        try:
            writer = df.write.partitionBy(*partition_by) if partition_by else df.write
            writer.parquet(f"{self.folder}/generation={name}")
        except Exception:
            self.discard(name)
            raise
        return name

    def _pointers(self) -> list[tuple[int, str]]:
        """Numbers and generations of the pointer files, the highest number first."""
        folder = self._path(f"{self.folder}/_pointers")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        parts = [n.partition("-") for n in names if not n.startswith(".")]
        return sorted(((int(a), b) for a, _, b in parts if a.isdigit() and b), reverse=True)

    def _complete(self, generation: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/generation={generation}/_SUCCESS"))

    def publish(self, generation: str) -> None:
        if not self._complete(generation):
            raise ValueError(f"no complete generation {generation}")
        old = self._pointers()
        number = old[0][0] + 1 if old else 0
        pointer = self._path(f"{self.folder}/_pointers/{number:020d}-{generation}")
        if not self._fs.createNewFile(pointer):
            raise RuntimeError("another generation was published at the same time")
        for n, name in old:
            self._fs.delete(self._path(f"{self.folder}/_pointers/{n:020d}-{name}"), False)
            if name != generation:
                self.discard(name)

    def discard(self, generation: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/generation={generation}"), True)

    def live(self) -> str | None:
        return next((name for _, name in self._pointers() if self._complete(name)), None)

    def read(self) -> DataFrame | None:
        name = self.live()
        return None if name is None else self.spark.read.parquet(f"{self.folder}/generation={name}")


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """The rows whose columns equal all given values (a null value asks for null); unknown columns are an error."""
    for name, value in wanted.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    return df


def repository_list(repositories: DataFrame, workspace_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of repositories, each once by its newest row, the newest first and of equals the least id."""
    rows = tenant(repositories, workspace_id) if workspace_id is not None else repositories
    return page(latest_rows(rows, ["id"], "updated_at"), [F.desc_nulls_last("created_at"), F.col("id")], limit, offset)


def repository_health(repositories: DataFrame) -> DataFrame:
    """One row ``total, indexed, failed, pending`` of the newest status of each repository."""
    s = F.col("indexing_status")
    now = latest_rows(repositories.select("id", "updated_at", "indexing_status"), ["id"], "updated_at")
    return now.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "ready").alias("indexed"), F.count_if(s == "index_failed").alias("failed"), F.count_if(s.isin("indexing", "pending")).alias("pending"))


def repository_metrics(repositories: DataFrame, files: DataFrame) -> DataFrame:
    """One row ``total, indexed, pending, failed, n_files, n_chunks``; a ``failed`` one counts as pending and as failed."""
    s = F.coalesce(F.col("indexing_status"), F.lit(""))
    now = latest_rows(repositories.select("id", "updated_at", "indexing_status", "total_chunks"), ["id"], "updated_at")
    counts = now.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "ready").alias("indexed"), F.count_if(~s.isin("ready", "index_failed", "failed_import")).alias("pending"),
        F.count_if(s.isin("index_failed", "failed_import", "failed")).alias("failed"), F.sum("total_chunks").cast("long").alias("n_chunks"),
    )
    return counts.crossJoin(files.agg(F.countDistinct("file_id").alias("n_files")))  # one row each


def embedding_progress(repositories: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row ``total_chunks, embedded, pending``: chunks as stated, of which the vectors that there are, or none."""
    stated = latest_rows(repositories.select("id", "updated_at", "total_chunks"), ["id"], "updated_at").agg(F.coalesce(F.sum("total_chunks"), F.lit(0)).cast("long").alias("total_chunks"))
    both = stated.crossJoin(vectors.agg(F.count(F.lit(1)).alias("embedded")))  # one row each
    return both.select("total_chunks", "embedded", F.greatest(F.col("total_chunks") - F.col("embedded"), F.lit(0)).alias("pending"))


def ordered_distinct(df: DataFrame, key: list[str], order: Column, value: str) -> DataFrame:
    """``key, position, value``: each value of a key once, at the place of its first occurrence."""
    first = df.groupBy(*key, value).agg(F.min(order).alias("position"))
    return first.select(*key, "position", value)
