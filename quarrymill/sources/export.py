"""Exports: a bounded list as one JSON array, a report as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.topk import ranked


def json_array(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """One row, json: the first ``most`` rows by ``order`` as an array of objects. The bound is the export's size, so the array may be one value."""
    top = df.orderBy(*order).limit(most).withColumn("__place", F.row_number().over(Window.orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("__place", F.struct(*df.columns).alias("__x"))))
    return top.agg(F.to_json(F.transform(rows, lambda r: r["__x"])).alias("json"))


def report_lines(profile: DataFrame, title: str, columns: list[str], order: list[Column]) -> DataFrame:
    """value, place: a headline and a line a row of a profile, in order of place; write the values with ``write.text``."""
    lines = ranked(profile, order).select(F.concat_ws("  ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value"), "place")
    head = profile.sparkSession.range(1).select(F.lit(f"== {title}: {', '.join(columns)}").alias("value"), F.lit(0).cast("long").alias("place"))
    return head.unionByName(lines)
