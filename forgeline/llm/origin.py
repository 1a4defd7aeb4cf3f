"""Generated, minified or vendored source files and data saved as code (problem 4).

Merkle hashes: the blocks of a file (separated by blank lines, without white space) are the leaves, a file's hash
is that of its blocks in order, and a directory's combines those of its children whatever their names, level by
level from the deepest. What occurs in unrelated repositories is vendored: whole subtrees, files, and files of
which shared blocks make up half (changed or shortened copies). Forks are related, so what only they share is not.
Hashes combine by sums, so that aggregates run map-side and no directory is gathered. Besides, the directories of
package tools are vendored. Header and layout rules, on whole texts, find what a tool wrote.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from forgeline.llm.syntax import LANGUAGES, extension
from forgeline.session import materialize, read_together

# Phrases by which tools mark their output, in English and the other languages of the corpus.
GENERATED = re.compile(
    r"@generated\b|<auto-?generated\b|\bcode generated by\b|\bauto-?generated (?:file|by|from|code)\b"
    r"|\b(?:file|code|module|source) (?:was|is|has been) (?:auto-?matically |auto-?)(?:created|generated|produced|built|written)\b"
    r"|\bautomatically (?:created|generated|produced|written) (?:by|from)\b|\bgenerated by the \S+ compiler\b"
    r"|\b(?:produced|generated|built|compiled|emitted) (?:by \S+(?: v?\d[\w.]*)? from|from \S+ by) \S+"
    r"|automatisch (?:von|durch|aus|mit) .{1,80}?(?:erzeugt|generiert|erstellt)|(?:généré|créé|produit) automatiquement (?:par|à partir)|(?:generado|creado) automáticamente (?:por|a partir)",
    re.I,
)
# File and directory names that tools give to their output.
GENERATED_PATH = re.compile(r"(?:^|/)(?:__generated__|_generated|generated)/|_pb2(?:_grpc)?\.py$|\.(?:gen|g|generated)\.[cm]?[jt]sx?$|(?:^|/)client/models/gen_|(?:^|/)parsetab\w*\.py$", re.I)
MINIFIED_PATH = re.compile(r"\.min\.[cm]?js$", re.I)
# The directories in which package tools keep third-party code.
VENDOR_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|site-packages|third_party|3rdparty|vendor|external|deps)/", re.I)
_SKIP = re.compile(r"""(?:\s+|['"]use strict['"];?|\#!?[^\n]*|//[^\n]*|/\*.*?\*/|[rub]{0,2}\"\"\".*?\"\"\"|[rub]{0,2}'''.*?''')+""", re.S | re.I)
_LOGIC = re.compile(r"\b(?:def|function|return|if|for|while|class|import|try|switch|await|raise|throw|yield|lambda|interface|enum|require)\b|=>")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|(?<![\w$])[-+]?\.?\d[\w.]*")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_SERIAL = re.compile(r"[A-Za-z]_(\d+)(?![\w.])")
LONG_LINE, LEAST_ATOMS = 250, 40
#: Letters that make a block, and a file or directory, telling enough; the part of a file that must be shared; the part of
#: a repository's files that makes it a fork.
LEAST_BLOCK, LEAST_SHARED, SHARED_WEIGHT, FORK_SHARE = 40, 100, 0.5, 0.5


def header(source: str) -> str:
    """The comments before the first statement."""
    m = _SKIP.match(source.removeprefix("﻿"))
    return m[0] if m else ""


def _minified(source: str, path: str) -> bool:
    lines = source.split("\n")
    packed = sum(len(x) for x in lines if len(x) > LONG_LINE)
    if packed < 0.7 * len(source):
        return False
    if MINIFIED_PATH.search(path):
        return True
    code = _LITERAL.sub("", source)
    words = _WORD.findall(code)
    blank = sum(map(code.count, " \t\n")) / max(1, len(code))
    return len(words) > 20 and sum(len(w) <= 3 for w in words) > 0.4 * len(words) and blank < 0.25


def _is_data(source: str) -> bool:
    """Literals and marks only: nothing but a few names outside of them, and no statement with logic."""
    body = source[len(header(source)) :]
    code, atoms = _LITERAL.subn("0", body)
    if _LOGIC.search(code):
        return False
    literal = len(body) - len(code) + atoms
    words = _WORD.findall(code)
    names = len(words) if len(set(words)) > 12 or len(words) < 12 else len(set(words))  # keys of records come again and again
    if names > 4 + 0.05 * atoms and len(words) > 1.5 * atoms:
        return False
    return atoms >= LEAST_ATOMS or literal > 600 and literal > 0.8 * len(body)


def _numbered(source: str) -> bool:
    """Names numbered from 0 without a gap, on nearly all lines: the layout of what is printed from a list."""
    serials = {int(x) for x in _SERIAL.findall(source) if len(x) < 7}
    if len(serials) < 4 or serials != set(range(len(serials))):
        return False
    body = source[len(header(source)) :]
    lines = [x for x in body.split("\n") if x.strip()]
    return len(serials) >= 6 or len(_SERIAL.findall(source)) > 0.3 * len(lines)


def layout_kind(path: str, source: str | None) -> str | None:
    """``generated``, ``minified``, ``data`` or None."""
    if not source or source.isspace():
        return None
    text = source.replace("\r\n", "\n")
    head = header(text)
    if head and GENERATED.search(" ".join(head.split())) or GENERATED_PATH.search(path):
        return "generated"
    if _minified(text, path):
        return "minified"
    if _numbered(text):
        return "generated"
    return "data" if _is_data(text) else None


@F.pandas_udf(StringType())
def _layout(path: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([layout_kind(p, s) for p, s in zip(path, source)], dtype=object)


def _clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./)+", "")


def _blocks(source: Column) -> Column:
    """The hashes and lengths of a file's blocks, without white space and imports."""
    parts = F.split(F.regexp_replace(F.regexp_replace(source, "\r", ""), r"(?m)^(?:import|from)\b.*$", ""), r"\n[ \t]*\n(?=\S)")
    packed = F.transform(parts, lambda b: F.regexp_replace(b, r"\s+", ""))
    return F.transform(F.filter(packed, lambda b: F.length(b) > 0), lambda b: F.struct(F.xxhash64(b).alias("h"), F.length(b).alias("n")))


def families(files: DataFrame) -> DataFrame:
    """``repo, family``: forks and copies of one project form a family, named by its least repository.

    ``files`` has ``repo, hash``. A repository belongs to the family of the repository that is the least to hold
    more than :data:`FORK_SHARE` of its distinct files; all counts are aggregates, no two repositories are paired.
    """
    own = materialize(files.select("repo", "hash").distinct(), "holdings")
    least = own.groupBy("hash").agg(F.min("repo").alias("family"))
    held = own.join(least, "hash").groupBy("repo", "family").agg(F.count(F.lit(1)).alias("n"))
    total = held.groupBy("repo").agg(F.sum("n").alias("all"), F.max_by("family", F.struct("n", "family")).alias("most"), F.max("n").alias("n"))
    return total.select("repo", F.when(F.col("n") > FORK_SHARE * F.col("all"), F.col("most")).otherwise(F.col("repo")).alias("family"))


def _in_several(rows: DataFrame, key: str) -> DataFrame:
    """The keys that occur in more than one family: the least and the greatest of them differ."""
    return rows.groupBy(key).agg(F.min("family").alias("lo"), F.max("family").alias("hi")).filter(F.col("lo") != F.col("hi")).select(key)


def shared_subtrees(files: DataFrame) -> DataFrame:
    """The directories ``repo, dir`` whose Merkle hash occurs in more than one family, from the deepest level up.

    ``files`` has ``repo, path, hash`` and, if forks and short files are to be told apart, ``family`` and ``size``. A directory's hash is that of the sum and number of its children's
    mixed hashes, so names and order do not count but repeats do. Directories with less than :data:`LEAST_SHARED`
    letters in all their files are no evidence, as anyone may write the same few lines.
    """
    for name, default in (("family", F.col("repo")), ("size", F.lit(LEAST_SHARED))):
        files = files if name in files.columns else files.withColumn(name, default)
    steps = F.split("path", "/")
    at = materialize(files.select("repo", "family", (F.size(steps) - 1).alias("depth"), F.slice(steps, 1, F.size(steps) - 1).alias("dir"), "hash", "size"), "leaves")
    deepest = at.agg(F.max("depth").alias("d")).first()["d"] or 0
    levels: list[DataFrame] = []
    for d in range(deepest, 0, -1):
        here = at.filter(F.col("depth") == d).select("repo", "family", "dir", "hash", "size")
        if levels:
            here = here.unionByName(levels[-1].select("repo", "family", F.slice("dir", 1, d).alias("dir"), "hash", "size"))
        mixed = F.sum(F.xxhash64(F.lit(7), "hash").cast("decimal(20,0)"))
        # each level is written once, as the next one and the search for shared hashes both read it
        levels.append(materialize(here.groupBy("repo", "family", "dir").agg(mixed.alias("mixed"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).select("repo", "family", "dir", F.xxhash64("mixed", "n").alias("hash"), "size"), "level"))
    if not levels:
        return files.select("repo", F.col("path").alias("dir")).limit(0)
    out = read_together(levels).filter(F.col("size") >= LEAST_SHARED).select("repo", "family", F.array_join("dir", "/").alias("dir"), "hash")
    return out.join(_in_several(out, "hash"), "hash", "left_semi").select("repo", "dir").distinct()


def foreign_files(df: DataFrame, file_id: str = "file_id", repository: str = "repository_id", path: str = "file_path", source: str = "source_code") -> DataFrame:
    """``file_id, kind`` of each file that was not written by hand in its repository, once a file.

    Kinds, the first that holds: ``generated``, ``minified``, ``vendored``, ``data``. Only the extensions of
    :data:`LANGUAGES` are judged; rows without an id or path, and null, empty or blank sources, give no row. Repeated
    rows count once; a null repository is one of its own.
    """
    code = (
        df.select(F.col(file_id).alias("file_id"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"), _clean_path(F.col(path)).alias("path"), F.col(source).alias("src"))
        .filter(extension(F.col("path")).isin(*LANGUAGES) & F.col("file_id").isNotNull() & (F.length("src") > 0))
    )
    facts = code.select("file_id", "repo", "path", _layout("path", "src").alias("layout"), _blocks(F.col("src")).alias("blocks")).withColumn("hash", F.xxhash64(F.transform("blocks", lambda b: b["h"])))
    facts = materialize(facts.withColumn("size", F.aggregate("blocks", F.lit(0), lambda a, b: a + b["n"])), "facts")
    distinct = facts.filter(F.col("size") > 0).dropDuplicates(["file_id"]).join(families(facts.filter(F.col("size") > 0)), "repo")
    hashed = materialize(distinct.select("file_id", "repo", "family", "path", "hash", "size", "blocks"), "hashed")
    by_dir = shared_subtrees(hashed)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    in_dirs = facts.filter(F.size(parts) > 1).select("file_id", "repo", F.explode(above).alias("dir")).join(by_dir, ["repo", "dir"], "left_semi").select("file_id")
    leaves = hashed.select("file_id", "family", F.explode("blocks").alias("b")).select("file_id", "family", F.col("b.h").alias("h"), F.col("b.n").alias("n")).filter(F.col("n") >= LEAST_BLOCK)
    several = _in_several(leaves, "h").withColumn("shared", F.lit(True))
    weight = leaves.join(several, "h", "left").groupBy("file_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("shared"), F.col("n")).otherwise(0)).alias("common"))
    copies = weight.filter((F.col("common") >= SHARED_WEIGHT * F.col("all")) & (F.col("common") >= LEAST_SHARED)).select("file_id")
    kept = facts.filter(F.col("path").rlike("(?i)" + VENDOR_PATH.pattern)).select("file_id")
    order = F.when(F.col("kind") == "generated", 0).when(F.col("kind") == "minified", 1).when(F.col("kind") == "vendored", 2).otherwise(3)
    rows = facts.filter(F.col("layout").isNotNull()).select("file_id", F.col("layout").alias("kind"))
    for more in (in_dirs, copies, kept):
        rows = rows.unionByName(more.withColumn("kind", F.lit("vendored")))
    return rows.groupBy("file_id").agg(F.min_by("kind", order).alias("kind"))
