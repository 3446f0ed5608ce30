"""All registered queries of the library itself, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilgrain.plans import analytics, evaluation, exchange, models, planted, records, situations, streams, text

flagship = text.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*analytics.QUERIES, *text.QUERIES, *records.QUERIES, *exchange.QUERIES, *situations.QUERIES, *models.QUERIES, *evaluation.QUERIES, *planted.QUERIES, *streams.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return analytics.SQL | text.SQL | records.SQL | exchange.SQL | situations.SQL | models.SQL | evaluation.SQL | planted.SQL | streams.SQL
