"""Queries of the training-data problems: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from __future__ import annotations

from forgeline.llm import encode, lookalike, mixing, origin, pairs, secrets, syntax
from forgeline.session import table, wide_table


def p1_found(spark, sf_dir):
    return pairs.broken_pairs(wide_table(spark, sf_dir, "query_responses"))


def p2_found(spark, sf_dir):
    return syntax.broken_files(wide_table(spark, sf_dir, "code_chunks")).select("file_id")


def p2_rates(spark, sf_dir):
    return syntax.failure_rates(wide_table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "parse_results"))


def p4_found(spark, sf_dir):
    return p4_kinds(spark, sf_dir).select("file_id")


def p4_kinds(spark, sf_dir):
    return origin.foreign_files(wide_table(spark, sf_dir, "code_chunks"))


def p5_found(spark, sf_dir):
    return secrets.secret_lines(wide_table(spark, sf_dir, "code_chunks"))


def p5_redacted(spark, sf_dir):
    files = wide_table(spark, sf_dir, "code_chunks").select("file_id", "file_path", "source_code")
    return secrets.redact_secrets(files).select("file_id", "redacted_code")


def p6_ids(spark, sf_dir):
    return encode.encode_corpus(wide_table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_mixture(spark, sf_dir):
    return mixing.mix_sources(wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_shares(spark, sf_dir):
    return mixing.mix_report(wide_table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p8_found(spark, sf_dir):
    return lookalike.lookalike_pairs(wide_table(spark, sf_dir, "documents"))


def p8_consistent(spark, sf_dir):
    docs = wide_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lookalike.consistent_text(docs).select("doc_id", "text_form")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict:
    return {}
