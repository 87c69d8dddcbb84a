"""Ranking: caps per group, round-robin orders, pages, samples.

Orders over a whole set are cut to what the page can show before they are ranked, so a large group never meets in one
task: a page of m rows from row n on holds ranks up to n + m of any group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], cap: int, rank: str = "rn") -> DataFrame:
    """The first ``cap`` rows of each group, with their rank (long)."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= cap).withColumn(rank, F.col(rank).cast("long"))


def page_bounds(page, size, default: int = 24, most: int = 96) -> tuple[int, int]:
    """(offset, limit) of a request: pages count from 1, sizes lie within 1 and ``most``; what is no number gives the default."""

    def number(x, default):
        try:
            return int(x)
        except (TypeError, ValueError):
            return default

    page, size = max(1, number(page, 1)), min(most, max(1, number(size, default)))
    return (page - 1) * size, size


def interleave(df: DataFrame, group: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the listing that takes each group's first, then each group's second, and so on; groups by value."""
    ranked = cap_per_group(df, [group], order, offset + limit)
    return ranked.orderBy("rn", group).offset(offset).limit(limit)


def round_robin(df: DataFrame, group: str, position: str) -> DataFrame:
    """A bounded list in the order of a queue of buckets: groups come in the order of their first row. Adds rn and bp."""
    by = Window.partitionBy(group)
    return df.withColumn("rn", F.row_number().over(by.orderBy(position)).cast("long")).withColumn("bp", F.min(position).over(by))


def diversify(df: DataFrame, category: str, brand: str, order: list[Column], limit: int = 50) -> DataFrame:
    """Two-level round-robin of a bounded ranked list: brands alternate within a category, categories alternate; adds place from 1.

    A null category or brand is a bucket of its own, the empty name.
    """
    rows = df.withColumn("__c", F.coalesce(F.col(category).cast("string"), F.lit(""))).withColumn("__b", F.coalesce(F.col(brand).cast("string"), F.lit("")))
    rows = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    pair, cat = Window.partitionBy("__c", "__b"), Window.partitionBy("__c")
    rows = rows.withColumn("rb", F.row_number().over(pair.orderBy("pos"))).withColumn("bp", F.min("pos").over(pair))
    rows = rows.withColumn("k", F.row_number().over(cat.orderBy("rb", "bp"))).withColumn("cp", F.min("pos").over(cat))
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("k", "cp")).cast("long"))
    return rows.where(F.col("place") <= limit).drop("__c", "__b", "pos", "rb", "bp", "k", "cp")


def diverse_pick(df: DataFrame, combo: list[str], shuffled: list[Column], first: int, n: int) -> DataFrame:
    """n rows: up to ``first`` of each combination before any further ones, each in shuffled order."""
    rank = F.row_number().over(Window.partitionBy(*combo).orderBy(*shuffled))
    return df.withColumn("rn", rank.cast("long")).where(F.col("rn") <= n).orderBy((F.col("rn") > first).cast("int"), *shuffled).limit(n)


def sample_per_group(df: DataFrame, group: list[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of each group in the order of the md5 of seed and key; reruns agree."""
    return cap_per_group(df, group, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)], n)


def clamped_page(df: DataFrame, order: list[Column], page, size: int = 48) -> tuple[int, int, DataFrame]:
    """(rows in all, number of the page, its rows): a page beyond the last is the last, one before the first the first."""
    total = df.count()
    wanted, _ = page_bounds(page, size, most=size)
    page = min(wanted // size + 1, max(1, -(-total // size)))
    return total, page, df.orderBy(*order).offset((page - 1) * size).limit(size)


def resorted(pool: DataFrame, price: str, key: str, descending: bool) -> DataFrame:
    """A returned pool, which is small, by price, rows without one last either way; adds place from 1."""
    order = F.col(price).desc_nulls_last() if descending else F.col(price).asc_nulls_last()
    return pool.withColumn("place", F.row_number().over(Window.orderBy(order, key)).cast("long"))


def cap_protecting(df: DataFrame, protected: Column, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows, protected ones before others, each by ``order``."""
    return df.orderBy(F.when(protected, 0).otherwise(1), *order).limit(most)


def featured(df: DataFrame, brand: str, newest: list[Column], cap: int, offset: int, limit: int) -> DataFrame:
    """A page of the featured listing: each brand's newest, cut to ``cap``, in the order of newness, then one brand after the other; adds rn and bp."""
    capped = cap_per_group(df, [brand], newest, cap, "__r").drop("__r")
    queue = capped.withColumn("pos", F.row_number().over(Window.orderBy(*newest)).cast("long"))  # ``cap`` rows a brand at most
    return round_robin(queue, brand, "pos").orderBy("rn", "bp").offset(offset).limit(limit)


def coverage_top_up(picked: DataFrame, pool: DataFrame, key: str, group: str, least: int, order: list[Column]) -> DataFrame:
    """``picked`` and, for groups with fewer than ``least`` rows in it, rows of the pool up to that number."""
    have = picked.groupBy(group).agg(F.count("*").alias("__have"))
    rest = pool.join(picked.select(key), key, "left_anti").join(have, group, "left").withColumn("__lack", least - F.coalesce("__have", F.lit(0)))
    extra = cap_per_group(rest.where("__lack > 0"), [group], order, least, "__rn").where(F.col("__rn") <= F.col("__lack"))
    return picked.unionByName(extra.select(*picked.columns))


def listing_order(sort: str | None, price: str, seen: str, key: str) -> list[Column]:
    """Order columns of a sort name; unknown names order by key. Nulls come last either way."""
    return {
        "price_asc": [F.col(price).asc_nulls_last(), F.col(key)],
        "price_desc": [F.col(price).desc_nulls_last(), F.col(key)],
        "newest": [F.col(seen).desc_nulls_last(), F.col(key).desc()],
    }.get(sort or "", [F.col(key)])


def ranked(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """``df`` with its place (long, from 1) in an order over the whole set, in two levels: ranges of the order, then places within one, so no task holds all rows."""
    # a range may not part rows that tie: the order ends with a key
    keyed = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    before = keyed.groupBy("__part").agg(F.count("*").alias("__n"))  # at most a row a shuffle partition
    before = before.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return keyed.withColumn("__r", within).join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(place, (F.col("__base") + F.col("__r")).cast("long")).drop("__part", "__p", "__base", "__r")
