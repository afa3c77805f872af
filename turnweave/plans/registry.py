"""All queries of the core and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnweave.plans import queries_corpora, queries_dialog, queries_files, queries_samples, queries_signal, queries_vad

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (queries_dialog, queries_vad, queries_signal, queries_files, queries_samples, queries_corpora)


def queries() -> dict[str, Query]:
    return {k: q for part in _PARTS for k, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.SQL.items()}
