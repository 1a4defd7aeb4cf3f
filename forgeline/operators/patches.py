"""Unified diffs applied to many files at once, with strict context, hashes and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.functions.text import is_protected_path, is_safe_path

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
MAX_BYTES = 1_000_000


class PatchError(ValueError):
    """A diff that does not fit."""


def apply_diff(original: str, diff: str) -> str:
    """The text after a unified diff of one file. Context and removed lines have to match, hunks have to be in order
    and to hold as many lines as they state."""
    old, out, at = original.split("\n"), [], 0
    lines = diff.split("\n")
    i = next((k for k, x in enumerate(lines) if x.startswith("@@")), None)
    if i is None:
        raise PatchError("no hunk")
    while i < len(lines):
        if lines[i] == "" and i == len(lines) - 1:
            break
        m = _HUNK.match(lines[i])
        if not m:
            raise PatchError(f"no hunk header: {lines[i][:80]}")
        start, n_old, n_new = int(m[1]), int(m[2] or 1), int(m[4] or 1)
        first = start if n_old == 0 else start - 1
        if first < at or first > len(old):
            raise PatchError("hunks overlap or lie outside")
        out += old[at:first]
        at, i, seen_old, seen_new = first, i + 1, 0, 0
        while seen_old < n_old or seen_new < n_new:
            if i >= len(lines):
                raise PatchError("the hunk ends early")
            mark, text = lines[i][:1] or " ", lines[i][1:]
            if mark == "\\":
                i += 1
                continue
            if mark not in " +-":
                raise PatchError(f"no line of a hunk: {lines[i][:80]}")
            if mark != "+":
                if at >= len(old) or old[at] != text:
                    raise PatchError(f"line {at + 1} differs")
                at, seen_old = at + 1, seen_old + 1
            if mark != "-":
                out.append(text)
                seen_new += 1
            i += 1
        if (seen_old, seen_new) != (n_old, n_new):
            raise PatchError("the hunk's counts are wrong")
        while i < len(lines) and lines[i].startswith("\\"):
            i += 1
    return "\n".join(out + old[at:])


def apply_patches(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``file_path, outcome, source_code`` for each edit (``file_path, expected_hash, diff``), each path once.

    Outcomes: ``applied``; ``unsafe`` and ``protected`` paths; ``repeated`` for paths with several edits; ``missing``
    files; ``conflict`` where the file's hash is not the expected one; else the reason why the diff does not fit.
    """
    n = edits.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.min("expected_hash").alias("expected_hash"), F.min("diff").alias("diff"))
    both = n.join(files.select("file_path", "source_code"), "file_path", "left")
    verdict = (
        F.when(~is_safe_path(F.col("file_path")), "unsafe").when(is_protected_path(F.col("file_path")), "protected").when(F.col("n") > 1, "repeated").when(F.col("source_code").isNull(), "missing")
        .when(F.col("expected_hash").isNotNull() & (F.sha2("source_code", 256) != F.col("expected_hash")), "conflict").when((F.octet_length("diff") > MAX_BYTES) | (F.octet_length("source_code") > MAX_BYTES), "too large")
    )
    rows = both.select("file_path", verdict.alias("outcome"), "source_code", "diff")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, outcome, source, diff in batch.itertuples(index=False):
                if outcome is None:
                    try:
                        outcome, source = "applied", apply_diff(source, diff or "")
                    except PatchError as e:
                        outcome = str(e)
                out.append((path, outcome, source))
            yield pd.DataFrame(out, columns=["file_path", "outcome", "source_code"])

    return rows.mapInPandas(run, "file_path string, outcome string, source_code string")


PROPOSAL = "struct<summary:string,edits:array<struct<file_path:string,expected_hash:string,diff:string>>>"


def parsed_proposals(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, valid, summary, edits`` of proposals in JSON, around which one fence of code is allowed; anything else is
    not valid and has no edits."""
    body = F.regexp_replace(F.trim(F.col(text)), r"(?s)^```(?:json)?[ \t]*\n(.*?)\n?```$", "$1")
    read = F.from_json(F.trim(body), PROPOSAL)
    valid = body.rlike(r"(?s)^\s*\{.*\}\s*$") & read["edits"].isNotNull()
    return answers.select(key, F.coalesce(valid, F.lit(False)).alias("valid"), F.when(valid, read["summary"]).alias("summary"), F.when(valid, read["edits"]).otherwise(F.array().cast("array<struct<file_path:string,expected_hash:string,diff:string>>")).alias("edits"))
