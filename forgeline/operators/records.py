"""Vector records and their storage form, checks of vectors, and a hashing embedder."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# The fields of a record that storage keeps beside its metadata.
RESERVED = ("chunk_id", "repository_id", "file_path", "language", "symbol_type", "symbol_name", "start_line", "end_line", "code")
MAX_DIMENSION = 3072


def to_storage(records: DataFrame) -> DataFrame:
    """Flat records: null symbols are empty, null lines -1, and the metadata map one JSON text without reserved keys."""
    rest = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*RESERVED))
    return (
        records.withColumn("metadata_json", F.to_json(rest)).withColumn("symbol_name", F.coalesce("symbol_name", F.lit(""))).withColumn("symbol_type", F.coalesce("symbol_type", F.lit("")))
        .withColumn("start_line", F.coalesce("start_line", F.lit(-1))).withColumn("end_line", F.coalesce("end_line", F.lit(-1))).drop("metadata")
    )


def from_storage(stored: DataFrame) -> DataFrame:
    """The records of :func:`to_storage`. Metadata that is no JSON object is empty; code may lie in it."""
    meta = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = stored.withColumn("metadata", F.map_filter(meta, lambda k, v: k != "code")).withColumn("code", F.coalesce("code", meta["code"]))
    for c in ("symbol_name", "symbol_type"):
        rows = rows.withColumn(c, F.nullif(F.col(c), F.lit("")))
    for c in ("start_line", "end_line"):
        rows = rows.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    return rows.drop("metadata_json")


def with_code(records: DataFrame) -> DataFrame:
    """Records whose metadata has the code and lines, unless it has such keys already."""
    own = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (("code", "code"), ("start_line", "start_line"), ("end_line", "end_line"))]), lambda e: e["v"].isNotNull()))
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return records.withColumn("metadata", F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(meta, k)), meta))


def blank_texts(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose text can be embedded, and the keys of those without any letter."""
    blank = F.coalesce(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(0)) == 0
    return df.filter(~blank), df.filter(blank).select(key)


def vector_faults(df: DataFrame, vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    """The rows whose vector is null, empty, too long, of another length than ``dimension`` or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.coalesce(F.size(vector), F.lit(-1))
    wrong = (size < 1) | (size > MAX_DIMENSION) | (size != dimension if dimension else F.lit(False))
    return df.filter(F.coalesce(wrong | bad, F.lit(True)))


def hashed_embedding(dimension: int = 64):
    """A column function: words and word pairs hashed into signed counts of unit length; null and blank texts give null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = (t or "").lower().split()
            if not words:
                out.append(None)
                continue
            keys = [zlib.crc32(w.encode()) for w in [*words, *map(" ".join, zip(words, words[1:]))]]
            v = np.zeros(dimension, dtype=np.float32)
            np.add.at(v, [k % dimension for k in keys], [1.0 if k & 0x10000 else -1.0 for k in keys])
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).tolist())
        return pd.Series(out, dtype=object)

    return embed
