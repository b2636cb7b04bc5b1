"""The registered queries: each binds operators to the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evaluation, evidence, figures, images, panels, review


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return panels.QUERIES | evidence.QUERIES | corpus.QUERIES | evaluation.QUERIES | review.QUERIES | images.QUERIES | figures.QUERIES


def oracle_sql() -> dict[str, str]:
    return panels.ORACLE_SQL | evidence.ORACLE_SQL | corpus.ORACLE_SQL | evaluation.ORACLE_SQL | review.ORACLE_SQL | images.ORACLE_SQL | figures.ORACLE_SQL
