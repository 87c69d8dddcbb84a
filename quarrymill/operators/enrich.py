"""What a parent row gets from its children: the cheapest, the first, nested availability, look-ups with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cheapest_child(children: DataFrame, key: str, price: str, keep: list[str], tie: list[str], available: Column) -> DataFrame:
    """key, ``keep`` of the child with the least price (null last, then ``tie``), any_available, n_children. One aggregation."""
    order = F.struct(F.col(price).isNull().alias("a"), F.col(price).alias("b"), *[F.col(t) for t in tie])
    best = children.groupBy(key).agg(F.min_by(F.struct(*keep), order).alias("__best"), F.bool_or(available).alias("any_available"), F.count("*").alias("n_children"))
    return best.select(key, "__best.*", "any_available", "n_children")


def first_child(children: DataFrame, key: str, value: str, position: list[str], where: Column | None = None, name: str = "first") -> DataFrame:
    """key and the value of the first child by position, of those for which ``where`` holds."""
    rows = children if where is None else children.where(where)
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*position)).alias(name))


def first_match_or_first(parents: DataFrame, children: DataFrame, key: str, value: str, position: list[str], match: Column, name: str) -> DataFrame:
    """``parents`` with the first matching child's value, else the first child's."""
    best = first_child(children, key, value, position, match, "__match").join(first_child(children, key, value, position, None, "__any"), key, "full_outer")
    return parents.join(best.select(key, F.coalesce("__match", "__any").alias(name)), key, "left")


def availability_maps(children: DataFrame, key: str, color: str, size: str, available: Column) -> DataFrame:
    """key and by_color: a map colour -> map size -> whether any child has it available."""
    by_size = children.groupBy(key, color, size).agg(F.bool_or(available).alias("ok"))
    by_color = by_size.groupBy(key, color).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(size, "ok")))).alias("sizes"))
    return by_color.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(color, "sizes"))).alias("by_color"))


def fallback_lookup(rows: DataFrame, steps: list[tuple[DataFrame, list[tuple[str, str]], str]], name: str) -> DataFrame:
    """``rows`` with the first look-up that finds something; a step is (table, pairs of row column and table column, value column). Nulls match nulls."""
    found = []
    for i, (table, pairs, value) in enumerate(steps):
        side = table.select(*[F.col(b).alias(f"__{i}_{b}") for _, b in pairs], F.col(value).alias(f"__{i}"))
        test = F.lit(True)
        for a, b in pairs:
            test = test & F.col(a).eqNullSafe(F.col(f"__{i}_{b}"))
        rows = rows.join(side, test, "left").drop(*[f"__{i}_{b}" for _, b in pairs])
        found.append(F.col(f"__{i}"))
    return rows.withColumn(name, F.coalesce(*found)).drop(*[f"__{i}" for i in range(len(steps))])


def late_join(narrow: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The wide columns for a ranked page: the page is small, so the wide side is filtered before it moves."""
    return narrow.join(wide, key, "inner")


def attach_lists(rows: DataFrame, other: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """``rows`` with the list columns of another source by key; a miss gives empty lists and missed = true."""
    side = other.select(*keys, *lists).withColumn("__there", F.lit(True))
    met = rows.join(side, keys, "left")
    filled = {c: F.coalesce(F.col(c), F.array().cast(other.schema[c].dataType)) for c in lists}
    return met.withColumns(filled | {"missed": F.col("__there").isNull()}).drop("__there")


def keep_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row by ``order`` of each value of the key expression (say, a name in lower case), the others dropped."""
    whole = rows.withColumn("__k", key).groupBy("__k").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__x"))
    return whole.select("__x.*")


def color_cards(children: DataFrame, key: str, color: str, available: Column, image: Column, position: list[str]) -> DataFrame:
    """key and by_color: a map colour -> (any child available, the first image by position that isn't null)."""
    first = F.min_by(F.when(image.isNotNull(), image), F.when(image.isNotNull(), F.struct(*position)))
    each = children.where(F.col(color).isNotNull()).groupBy(key, color).agg(F.bool_or(available).alias("available"), first.alias("image"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(color), F.struct("available", "image"))))).alias("cards"))


def named_color(children: DataFrame, colors: DataFrame, color_id: str) -> DataFrame:
    """``children`` with color and hex from a dimension (id, name, hex); null where a child has no colour or an unknown one."""
    known = colors.select(F.col("id").alias("__color"), F.col("name").alias("color"), "hex")
    return children.join(known, F.col(color_id) == F.col("__color"), "left").drop("__color")
