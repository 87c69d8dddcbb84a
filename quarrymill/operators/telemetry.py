"""Metrics over a log of searches: buckets, rates, costs. The as-of time is always given, never the clock's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def since(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows later than ``as_of`` less the hours."""
    return df.where(F.col(ts) > as_of - F.expr(f"INTERVAL {hours} HOURS"))


def bucketed(df: DataFrame, ts: str, width: str, *aggs: Column) -> DataFrame:
    """bucket (its start) and the aggregates of each tumbling window that has rows; works on streams with a watermark too."""
    return df.groupBy(F.window(ts, width).alias("__w")).agg(*aggs).select(F.col("__w.start").alias("bucket"), *[f"`{c}`" for c in _names(df, ts, width, aggs)])


def _names(df: DataFrame, ts: str, width: str, aggs) -> list[str]:
    return df.groupBy(F.window(ts, width).alias("__w")).agg(*aggs).columns[1:]


def share(test: Column) -> Column:
    """Per cent of rows for which the test holds; zero without rows."""
    return F.coalesce(F.lit(100.0).cast("double") * F.count_if(test).cast("double") / F.nullif(F.count("*"), F.lit(0)).cast("double"), F.lit(0.0))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars for tokens at prices a million, six places; null for an unknown model (null price)."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)


def cost_sum(a: Column, b: Column) -> Column:
    """A null counts as zero, but null if both are."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def log_rows(searches: DataFrame, found_category: Column, found: Column, tokens: dict[str, Column]) -> DataFrame:
    """The rows to append to the search log: all searches but those whose category wasn't found, with results, zero and the token counts."""
    rows = searches.where(F.coalesce(found_category, F.lit(True)))
    return rows.withColumns({"results": found.cast("long"), "zero": found == 0} | tokens)


def append_log(rows: DataFrame, path: str, day: str) -> None:
    """Appends to the log, a folder a day, so that a day's panel reads that folder alone."""
    rows.write.mode("append").partitionBy(day).parquet(path)
