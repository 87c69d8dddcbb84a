"""Facet counts, bounds and latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def counts_with_zeros(dim: DataFrame, dim_key: str, rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Every row of the dimension with the number of rows that bear its key, zero included."""
    have = rows.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    return dim.join(have, F.col(dim_key) == F.col("__k"), "left").withColumn(name, F.coalesce("__n", F.lit(0)).cast("long")).drop("__k", "__n")


def distinct_counts(children: DataFrame, facet: str, parent: str, name: str = "n") -> DataFrame:
    """Distinct parents by facet value."""
    return children.where(F.col(facet).isNotNull()).groupBy(facet).agg(F.countDistinct(parent).alias(name))


def merged_counts(children: DataFrame, facet: str, canonical, parent: str, exact: bool, top: int, name: str = "n") -> DataFrame:
    """Counts by canonical facet value, the largest first. Not exact: the spellings' distinct counts are added, so a parent with two spellings counts twice."""
    if exact:
        merged = distinct_counts(children.withColumn("__c", canonical), "__c", parent, name).withColumnRenamed("__c", facet)
    else:
        merged = distinct_counts(children, facet, parent, "__n").withColumn("__c", canonical).groupBy("__c").agg(F.sum("__n").alias(name)).withColumnRenamed("__c", facet)
    return merged.orderBy(F.desc(name), facet).limit(top)


def bounds(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("low"), F.max(value).alias("high"))


def latest_per_group(df: DataFrame, group: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """``keep`` of each group's last row by ``order``. One aggregation, no sort of a group."""
    last = df.groupBy(*group).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("__x"))
    return last.select(*group, "__x.*")


def top_values(df: DataFrame, group: str, value: str, top: int) -> DataFrame:
    """The most frequent values of each group, with counts and ranks (long)."""
    from quarrymill.operators.topk import cap_per_group

    return cap_per_group(df.groupBy(group, value).agg(F.count("*").alias("n")), [group], [F.desc("n"), F.col(value)], top)


def dominance(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, the dominant value, its count, all, and the share of the others."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    out = n.groupBy(*group).agg(F.max_by(F.struct(value, "n"), F.struct("n", value)).alias("__x"), F.sum("n").alias("total"))
    return out.select(*group, F.col(f"__x.{value}").alias("dominant"), F.col("__x.n").alias("n"), "total", (1 - F.col("__x.n") / F.col("total")).alias("minority"))


def store_counts(df: DataFrame, store: str, shown: str) -> DataFrame:
    """store, n, shown: the entries of a drop-down of stores, by the name shown."""
    return df.groupBy(store).agg(F.count("*").alias("n"), F.max(shown).alias("shown")).orderBy("shown", store)


def option_sets(df: DataFrame, store: str, names: str, top: int = 8) -> DataFrame:
    """store, names (a set of option names in order, as one text), n, rn: the most frequent sets of each store."""
    from quarrymill.operators.topk import cap_per_group

    sets = df.withColumn("__s", F.array_join(F.array_sort(F.array_distinct(F.col(names))), " + ")).groupBy(store, F.col("__s").alias("names")).agg(F.count("*").alias("n"))
    return cap_per_group(sets, [store], [F.desc("n"), F.col("names")], top)


def null_shares(df: DataFrame, store: str, columns: list[str]) -> DataFrame:
    """store and, for each column, the per cent of rows that lack it (null or empty text)."""
    lacks = lambda c: F.avg(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), 100.0).otherwise(0.0))
    return df.groupBy(store).agg(*[F.round(lacks(c), 6).alias(c) for c in columns])


def sample_titles(df: DataFrame, store: str, kind: str, title: str, key: str, kinds: int = 3, most: int = 8) -> DataFrame:
    """store, kind, title, rn: the first ``most`` titles by key of each store's ``kinds`` most frequent kinds."""
    from quarrymill.operators.topk import cap_per_group

    frequent = top_values(df, store, kind, kinds).select(store, kind)
    rows = df.join(frequent, [store, kind], "left_semi")
    return cap_per_group(rows, [store, kind], [F.col(key)], most).select(store, kind, title, "rn")
