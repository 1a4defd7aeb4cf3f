"""Source files that do not parse (problem 2): lexers, a pushdown automaton, and for Python an exact check behind it."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from forgeline.llm import lexers, pushdown

# The extensions judged, with the language they stand for.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}

_automata: dict[str, pushdown.Automaton] = {}


def _automaton(language: str) -> pushdown.Automaton:
    if language not in _automata:
        _automata[language] = {
            "python": lambda: pushdown.Automaton(pushdown.PYTHON, contextual=frozenset(["match", "case"]), python=True),
            "javascript": lambda: pushdown.Automaton(pushdown.JS, contextual=lexers.JS_CONTEXTUAL),
            "typescript": lambda: pushdown.Automaton(pushdown.JS, pushdown.TS, contextual=lexers.JS_CONTEXTUAL | lexers.TS_CONTEXTUAL),
        }[language]()
    return _automata[language]


def _python_parses(source: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source.removeprefix("﻿"))
        return True
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):  # nested more deeply than the parser here can follow
        return True


def failure(extension: str, source: str | None) -> str | None:
    """The kind of failure of a file, or None if it is valid, empty, null or of an extension that is not judged."""
    language = LANGUAGES.get(extension)
    if language is None or not source or source.isspace():
        return None
    try:
        if language == "python":
            kind = _automaton(language).failure(lexers.python_shape(source))
        else:
            kind = _automaton(language).failure(lexers.javascript_shape(source, language == "typescript", extension != "ts"))
    except lexers.Unterminated:
        kind = "unterminated literal"
    if kind and language == "python" and _python_parses(source):
        return None
    return kind


@F.pandas_udf(ArrayType(StringType()))
def _failures(extension: pd.Series, source: pd.Series) -> pd.Series:
    """Lists of none or one failure; a filter on a plain result would make Spark judge every file twice."""
    kinds = (failure(e, s) for e, s in zip(extension, source))
    return pd.Series([[k] if k else [] for k in kinds], dtype=object)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def broken_files(df: DataFrame, file_id: str = "file_id", path: str = "file_path", source: str = "source_code") -> DataFrame:
    """``file_id, failure`` of each file that is not valid in the language of its extension, once a file.

    Kinds: ``unterminated literal``, ``unbalanced delimiter``, ``premature end``, ``merge conflict`` and
    ``misplaced token``. Files with other extensions or without one, null and empty sources, and rows without an id
    give no row. Of repeated rows the least kind is kept. Texts are read where they lie; only failures are shuffled.
    """
    rows = df.select(F.col(file_id).alias("file_id"), extension(F.col(path)).alias("ext"), F.col(source).alias("src")).filter(F.col("ext").isin(*LANGUAGES) & F.col("file_id").isNotNull() & (F.length("src") > 0))
    return rows.select("file_id", F.explode(_failures("ext", "src")).alias("failure")).groupBy("file_id").agg(F.min("failure").alias("failure"))


def failure_rates(df: DataFrame, runs: DataFrame) -> DataFrame:
    """``repository_id, language, n_files, n_failed, failure_rate, reported_failed`` over the judged extensions.

    Files count once. ``reported_failed`` is the sum of files_failed over the repository's runs, each run once, for
    comparison (null without runs). A null repository is a group of its own.
    """
    files = (
        df.filter(F.col("file_id").isNotNull())
        .select("file_id", "repository_id", extension(F.col("file_path")).alias("ext"))
        .filter(F.col("ext").isin(*LANGUAGES))
        .groupBy("file_id")
        .agg(F.min("repository_id").alias("repository_id"), F.min("ext").alias("ext"))
    )
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    by = (
        files.join(broken_files(df), "file_id", "left")
        .groupBy("repository_id", names[F.col("ext")].alias("language"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("failure").alias("n_failed"))
    )
    reported = runs.groupBy("run_id").agg(F.min("repository_id").alias("rid"), F.max("files_failed").alias("f")).groupBy("rid").agg(F.sum("f").cast("long").alias("reported_failed"))
    return by.join(reported, by["repository_id"] == reported["rid"], "left").select(
        "repository_id", "language", "n_files", "n_failed", F.round(F.col("n_failed") / F.col("n_files"), 6).alias("failure_rate"), "reported_failed"
    )
