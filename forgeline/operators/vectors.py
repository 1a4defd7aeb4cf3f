"""Nearest neighbours for a set of query vectors, in blocks: exact over all vectors, or over the nearest cells of an index.

Vectors and queries are packed into blocks of bounded size, one row each; a task multiplies one block of vectors
with one of queries and keeps the k nearest of each query over all its blocks. The exact search lays vectors and queries on
a grid of about as many squares as there are shuffle partitions, whose sides follow from the two numbers of rows, so
that neither side is copied more often than it must. No task holds more than two blocks and a bounded number of nearest
lists, however large either side is. Blocks keep the precision of their column, single or double.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegralType

VECTORS_AT_ONCE, QUERIES_AT_ONCE, BLOCKS_KEPT = 4096, 512, 256
#: Rows of a cell of the index that one group of blocks holds.
ROWS_A_GROUP = 100_000


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def _types(df: DataFrame, key: str, vector: str) -> tuple[str, str]:
    """The types by which keys and elements travel: whole numbers as long, other keys as text; single precision stays."""
    whole = isinstance(df.schema[key].dataType, IntegralType)
    return "long" if whole else "string", "f4" if isinstance(df.schema[vector].dataType.elementType, FloatType) else "f8"


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))


def _packed(df: DataFrame, key: str, vector: str, rows: int, group: str | None = None) -> DataFrame:
    """Blocks ``ids, size, data, g`` of the non-null vectors, each of vectors of one length and one ``group``."""
    key_type, kind = _types(df, key, vector)
    arrow_key = pa.int64() if key_type == "long" else pa.string()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column(1))
            for size, g in sorted(set(zip(sizes.to_pylist(), whole.column(2).to_pylist()))):
                alike = whole.filter(pc.and_(pc.equal(sizes, size), pc.equal(whole.column(2), g)))
                for at in range(0, alike.num_rows, rows):
                    part = alike.slice(at, rows)
                    data = np.asarray(part.column(1).flatten(), dtype=kind).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(arrow_key)), pa.array([size], pa.int32()), pa.array([data], pa.binary()), pa.array([g], pa.int64())], names=["ids", "size", "data", "g"])

    kept = _sound(df, key, vector).select(F.col(key).cast(key_type), F.col(vector), (F.col(group) if group else F.lit(0)).cast("long").alias("g"))
    if group:
        kept = kept.repartition("g").sortWithinPartitions("g")
    return kept.mapInArrow(pack, f"ids array<{key_type}>, size int, data binary, g long")


def _asked(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("ids").alias("qids"), F.col("size").alias("qsize"), F.col("data").alias("qdata"), "g")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors of each query: ``query_id, {key}, distance, similarity, rank``, ties by the lesser key.

    Keys may be whole numbers or text. Null and empty vectors and null keys are left out on both sides; vectors of
    another length than the query's are no neighbours of it. A repeated key is a neighbour as often as it comes; a
    repeated query asks once. Empty tables give no rows.
    """
    squares = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asking = queries.dropDuplicates([key])
    n, m = (max(1, df.select(key).count()) for df in (vectors, asking))
    # n x columns + m x rows values are copied, which is least where rows : columns = n : m
    columns = min(squares, max(1, round(math.sqrt(squares * m / n))))
    rows = max(1, squares // columns)
    place = lambda ids, parts, seed: F.pmod(F.xxhash64(F.lit(seed), F.get(ids, F.lit(0))), F.lit(parts)).cast("long")
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    blocks = _packed(vectors, key, vector, VECTORS_AT_ONCE).withColumn("row", place("ids", rows, 1)).withColumn("column", every(columns))
    wanted = _packed(asking, key, vector, QUERIES_AT_ONCE).withColumn("column", place("ids", columns, 2)).withColumn("row", every(rows))
    at = F.col("row") * columns + F.col("column")
    return _joined(blocks.withColumn("g", at), _asked(wanted.withColumn("g", at)), k, key, *_types(vectors, key, vector), _types(queries, key, vector)[1])


def fitted_cells(vectors: DataFrame, n_cells: int = 64, sample_rows: int = 20_000, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> np.ndarray:
    """Centres of an index, by k-means over the ``sample_rows`` vectors with the least hashes of their keys, a bound that
    does not grow with the table. Null and empty vectors do not count; without any vector there is no centre."""
    sample = _sound(vectors, key, vector).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample_rows).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if sample.isEmpty():
        return np.empty((0, 0))
    return np.array(KMeans(k=n_cells, seed=seed, maxIter=15).fit(sample).clusterCenters())


def probes_needed(vectors: DataFrame, centres: np.ndarray, k: int, target: float = 0.95, sample_rows: int = 4_000, asked: int = 200, key: str = "vec_id", vector: str = "embedding", seed: int = 8) -> int:
    """How many cells a query must look into to find ``target`` of its k nearest, measured within ``sample_rows`` vectors
    of which ``asked`` are queries; both bounds do not grow with the table. Neighbours in a sample are farther than in
    the whole table, so the number is rather too high than too low."""
    fits = _sound(vectors, key, vector).filter(F.size(vector) == (centres.shape[1] if len(centres) else 0))
    rows = fits.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample_rows).select(vector).collect()
    if not rows:
        return max(1, len(centres))
    v = np.array([r[0] for r in rows], dtype=float)
    q = v[:asked]
    apart = lambda x: (x * x).sum(1)[None, :] - 2 * q @ x.T
    near = np.argsort(apart(v), axis=1)[:, : min(k, len(v))]
    cell = np.argmin((centres * centres).sum(1)[None, :] - 2 * v @ centres.T, axis=1)
    turn = np.argsort(np.argsort(apart(centres), axis=1), axis=1)  # the place of each cell in each query's order
    places = np.take_along_axis(turn, cell[near], axis=1).ravel()
    return int(np.quantile(places, target, method="higher")) + 1


def indexed(vectors: DataFrame, centres: np.ndarray, vector: str = "embedding", probes: int = 1) -> DataFrame:
    """Every row with ``cells``, the numbers of the ``probes`` nearest centres, the nearest first; a row whose vector is
    null or of another length than the centres' has none and is in no cell."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def cells(column: pd.Series) -> pd.Series:
        c = sent.value
        fits = np.array([x is not None and len(x) == c.shape[1] for x in column], dtype=bool)
        near: list[list[int]] = []
        if fits.any() and len(c):
            v = np.stack(list(column[fits])).astype(float)
            near = np.argsort((c * c).sum(1)[None, :] - 2 * v @ c.T, axis=1, kind="stable")[:, :probes].tolist()
        rest = iter(near)
        return pd.Series([next(rest, []) if ok else [] for ok in fits], dtype=object)

    return vectors.withColumn("cells", cells(F.col(vector)))


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Like :func:`nearest`, but of each query only the vectors in its ``probes`` nearest cells are looked at.

    All vectors are in the index, each in its nearest cell; vectors of another length than the centres' are in none. A
    cell is split in groups of about :data:`ROWS_A_GROUP` rows, so a cell that holds a third of all rows is searched by
    many tasks. What is found is right, what is missed is told by :func:`recall` against the exact search.
    """
    placed = indexed(_sound(vectors, key, vector), centres, vector).filter(F.size("cells") > 0).withColumn("cell", F.get("cells", F.lit(0)))
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # one row a cell
    groups = [max(1, math.ceil(sizes.get(c, 0) / ROWS_A_GROUP)) for c in range(len(centres))]
    starts = np.concatenate([[0], np.cumsum(groups)]).tolist()
    first, parts = F.array(*map(F.lit, starts[:-1] or [0])), F.array(*map(F.lit, groups or [1]))
    blocks = _packed(placed.withColumn("g", F.get(first, F.col("cell")) + F.pmod(F.xxhash64(key), F.get(parts, F.col("cell")))), key, vector, VECTORS_AT_ONCE, "g")
    asking = indexed(_sound(queries.dropDuplicates([key]), key, vector), centres, vector, probes).withColumn("cell", F.explode("cells"))
    asking = asking.withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.get(parts, F.col("cell")) - 1), lambda i: i + F.get(first, F.col("cell")))))
    return _joined(blocks, _asked(_packed(asking, key, vector, QUERIES_AT_ONCE, "g")), k, key, *_types(vectors, key, vector), _types(queries, key, vector)[1])


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row ``n_exact, n_found, recall``: how many of the exact neighbours were found."""
    hits = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))


def _joined(blocks: DataFrame, asked: DataFrame, k: int, key: str, key_type: str, kind: str, query_kind: str) -> DataFrame:
    """The k nearest of each query over all blocks that share its group."""
    if k <= 0:
        raise ValueError("k must be positive")
    query_type = asked.schema["qids"].dataType.elementType.simpleString().replace("bigint", "long")
    arrow = {"long": pa.int64(), "string": pa.string()}

    def best(ids: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((ids, distance))[:k]
        return ids[first], distance[first]

    def rows(kept: dict) -> pa.RecordBatch:
        lists = [(q, *x) for qids, near in kept.values() for q, x in zip(qids, near)]
        q = pa.array([q for q, i, _ in lists for _ in range(len(i))], arrow[query_type])
        found = pa.array(np.concatenate([i for _, i, _ in lists]).tolist(), arrow[key_type])
        return pa.RecordBatch.from_arrays([q, found, pa.array(np.concatenate([d for *_, d in lists]))], names=["query_id", key, "distance"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}  # by query block: the nearest so far of each of its queries
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["data"], dtype=kind).astype(float).reshape(-1, row["size"])
                q = np.frombuffer(row["qdata"], dtype=query_kind).astype(float).reshape(-1, row["qsize"])
                ids, qids = np.array(row["ids"]), row["qids"]
                rough = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T
                some = min(len(ids), k + 8)
                edges = np.partition(rough, some - 1, axis=1)[:, some - 1] * (1 + 1e-9) + 1e-6
                block = (qids[0], len(qids), zlib.crc32(row["qdata"]))
                old = kept.get(block, (qids, None))[1]
                near = []
                for j in range(len(qids)):
                    at = np.flatnonzero(rough[j] <= edges[j])
                    found, distance = ids[at], ((v[at] - q[j]) ** 2).sum(1)
                    if old is not None:
                        found, distance = np.concatenate([old[j][0], found]), np.concatenate([old[j][1], distance])
                    near.append(best(found, distance))
                kept[block] = (qids, near)
                if len(kept) >= BLOCKS_KEPT:
                    yield rows(kept)
                    kept.clear()
        if kept:
            yield rows(kept)

    # a set of queries against the vectors, block by block: each block of vectors meets the blocks of queries of its group
    pairs = blocks.join(asked, (blocks["g"] == asked["g"]) & (F.col("size") == F.col("qsize"))).select("ids", "size", "data", "qids", "qsize", "qdata")
    found = pairs.mapInArrow(search, f"query_id {query_type}, {key} {key_type}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", key, "distance", similarity(F.col("distance")).alias("similarity"), "rank")
