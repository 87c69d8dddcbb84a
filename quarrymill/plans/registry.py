"""Names every registered query together with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.plans import asked, browse, classified, extras, labelled, searching, shop, taxonomy, texts, upkeep

FLAGSHIP = "browse_interleaved_page"
_ALL = {**browse.QUERIES, **taxonomy.QUERIES, **upkeep.QUERIES, **searching.QUERIES, **texts.QUERIES, **extras.QUERIES, **shop.QUERIES, **classified.QUERIES, **labelled.QUERIES, **asked.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
