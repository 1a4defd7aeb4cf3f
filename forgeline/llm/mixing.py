"""Mixing sources to target weights by Poisson replication (problem 7).

A document's count is the inverse of a Poisson distribution at a number seeded by its id, so it is the same in every
run, on any cluster and for any order of rows. Its mean, the repetition rate of the source, is the largest one at
which the source's tokens do not exceed its part of the mixture. To find it, each document states the rates at which
its count rises by one; token sums by rate, of a fixed number of bins a source, then give the rate without sorting
or gathering any source. The mixture is as large as the scarcest source allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from forgeline.llm.encode import TOKENIZERS, count_tokens
from forgeline.session import materialize

#: Bins of rates a source; a source misses its part by at most a bin's tokens, or one document.
BINS = 1 << 14


def source_key(source: Column) -> Column:
    """One key for all spellings of a source: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(source), "[^\\p{L}\\p{N}]", "")


def uniform(*parts: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, that depends on the parts and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12).cast("double") + 0.5) / float(1 << 52)


def _rates(u: np.ndarray, k: int) -> np.ndarray:
    """The rate from which on the inverse Poisson distribution at ``u`` is at least ``k``: P(X <= k - 1) = u."""
    lo, hi = np.zeros_like(u), np.full_like(u, 64.0 + 4.0 * k)
    for _ in range(60):
        mid = (lo + hi) / 2
        log_term = -mid  # in logarithms, as the first terms of high rates are too small for a float
        total = np.exp(log_term)
        for i in range(1, k):
            log_term = log_term + np.log(mid / i)
            total += np.exp(log_term)
        above = total > u
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return hi


@F.pandas_udf(ArrayType(DoubleType()))
def rising_rates(u: pd.Series, most: pd.Series) -> pd.Series:
    """The rates at which a document's count becomes 1, 2, ... up to ``most``."""
    x, m = u.to_numpy(float), most.to_numpy(int)
    table = np.column_stack([_rates(x, k) for k in range(1, max(1, m.max(initial=1)) + 1)]) if len(x) else np.empty((0, 1))
    return pd.Series([row[:n] for row, n in zip(table, m)], dtype=object)


def _sized(docs: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, seed: int, tokenizer: str, folder: str) -> DataFrame:
    """The documents of wanted sources that have tokens: id, source, share, most, n_tokens and rates."""
    want = (
        targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
        .select(source_key(F.col("source")).alias("key"), F.col("source").alias("mix_source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))
    )
    texts = docs.select(F.col(doc_id).alias("id"), source_key(F.col(source)).alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    # the targets have one row a source, a size fixed by the mixture and not by the corpus; Spark broadcasts what is small
    sized = count_tokens(texts.join(want, "key"), "text", "n_tokens", tokenizer, folder).drop("key")
    return materialize(sized.withColumn("rates", rising_rates(uniform(F.col("id").cast("string"), seed=seed), F.col("most"))), "sized")


def mix_sources(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 11, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """The mixture, one row for each use of a document: ``doc_id, source, copy_no, n_tokens, shuffle_key``.

    ``targets`` has ``source, target_share, max_repeats``. Rows are in a global random order, that of
    ``shuffle_key``. Spellings that differ in case or marks are one source. Documents with a null source or one
    without target, and null and empty texts, which have no tokens, stay out. ``total_tokens`` is lowered to what
    the repeats allow; without it the mixture is the largest possible. Targets whose source has no document cannot
    be met: their share stays 0 and the others keep their proportions. Empty tables give an empty mixture. A doc_id
    on several rows makes each of them a document with the same random number.
    """
    sized = _sized(docs, targets, doc_id, text, source, seed, tokenizer, folder)
    return _mixed(sized, total_tokens, seed).select(F.col("id").alias("doc_id"), "source", "copy_no", "n_tokens", "shuffle_key").orderBy("shuffle_key", "doc_id", "copy_no")


def _mixed(sized: DataFrame, total_tokens: int | None, seed: int) -> DataFrame:
    has = sized.groupBy("mix_source").agg(F.sum("n_tokens").alias("own"), F.max("share").alias("share"), F.max("most").alias("most"))
    limit = has.agg(F.min(F.col("own") * F.col("most") / F.col("share")).alias("limit"))
    if total_tokens is not None:
        limit = limit.select(F.least("limit", F.lit(float(total_tokens))).alias("limit"))
    wanted = has.crossJoin(limit).select("mix_source", (F.col("share") * F.col("limit")).alias("wanted"))  # one row times the sources
    # rates are put in bins by x / (1 + x), which spreads them from 0 to 1
    by_rate = sized.select("mix_source", "n_tokens", F.explode("rates").alias("rate")).groupBy("mix_source", F.floor(F.col("rate") / (F.col("rate") + 1) * BINS).alias("bin")).agg(F.sum("n_tokens").alias("tokens"))
    running = by_rate.withColumn("so_far", F.sum("tokens").over(Window.partitionBy("mix_source").orderBy("bin")))
    # of the bin in which the part is reached, take or leave the whole, whichever comes nearer
    near = running.join(wanted, "mix_source").filter((F.col("so_far") <= F.col("wanted") * (1 + 1e-9)) | (F.col("so_far") - F.col("wanted") < F.col("wanted") - (F.col("so_far") - F.col("tokens"))))
    cut = near.groupBy("mix_source").agg(F.max("bin").alias("last"))
    n = F.size(F.filter("rates", lambda r: F.floor(r / (r + 1) * BINS) <= F.col("last")))
    used = sized.join(cut, "mix_source").withColumn("n", n)
    copies = used.filter("n > 0").select("id", F.col("mix_source").alias("source"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens")
    return copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), F.col("id").cast("string"), F.col("copy_no")))


def mix_report(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 11, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The shares reached: ``source, target_share, reached_share, n_tokens, n_documents, n_copies, max_used, max_repeats``."""
    sized = _sized(docs, targets, doc_id, text, source, seed, tokenizer, folder)
    mixed = _mixed(sized, total_tokens, seed)
    by = mixed.groupBy("source", F.col("id")).agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("uses").alias("n_copies"), F.max("uses").alias("max_used"))
    total = by.agg(F.sum("n_tokens").alias("total"))
    rows = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").join(total, F.lit(True), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("source", "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)), 6).alias("reached_share"), zero("n_tokens"), zero("n_documents"), zero("n_copies"), zero("max_used"), F.col("max_repeats").cast("long").alias("max_repeats"))
