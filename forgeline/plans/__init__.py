"""Query catalogue of the core: name -> (spark, sf_dir) -> DataFrame, and the same as SQL."""

from forgeline.plans import catalogue, graphs, hierarchy, maintenance, pipelines, search

MODULES = [hierarchy, search, graphs, catalogue, maintenance, pipelines]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
