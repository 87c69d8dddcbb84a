"""Filters over a product table and its variants, as Columns and semi-joins.

Every test on variants is a semi-join of its own, so two tests may be met by different variants of a product.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*tests: Column | None) -> Column:
    """Conjunction of the tests that are given; true without any."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def matches(column: str, needle: str | None) -> Column | None:
    """Case-insensitive substring; the needle's % and _ stay wildcards."""
    return F.col(column).ilike(f"%{needle}%") if needle else None


def any_child(parents: DataFrame, children: DataFrame, key: str, child_key: str, test: Column) -> DataFrame:
    """The parents that have a child for which the test holds."""
    hits = children.where(test).select(F.col(child_key).alias("__k"))
    return parents.join(hits, F.col(key) == F.col("__k"), "left_semi")


def on_sale(parents: DataFrame, children: DataFrame, key: str, child_key: str, price: Column, compare_at: Column) -> DataFrame:
    """A child's compare-at price is there and above its price."""
    return any_child(parents, children, key, child_key, compare_at.isNotNull() & (compare_at > price))


def with_color(parents: DataFrame, children: DataFrame, key: str, child_key: str, color: str, wanted: Iterable[str], fold: bool = False) -> DataFrame:
    """A child's colour is wanted: exactly (browsing), or with both sides in lower case (search)."""
    names = [w.lower() for w in wanted] if fold else list(wanted)
    return any_child(parents, children, key, child_key, (F.lower(color) if fold else F.col(color)).isin(names))


def with_color_of(parents: DataFrame, children: DataFrame, colors: DataFrame, key: str, child_key: str, color_id: str, wanted: Iterable[str], fold: bool = False) -> DataFrame:
    """The same where a child refers to a colour dimension (id, name): the dimension is filtered first, the children meet its ids, the parents meet these; a child without a colour has none."""
    names = [w.lower() for w in wanted] if fold else list(wanted)
    ids = colors.where((F.lower("name") if fold else F.col("name")).isin(names)).select(F.col("id").alias("__color"))
    return any_child(parents, children.join(ids, F.col(color_id) == F.col("__color"), "left_semi"), key, child_key, F.lit(True))


def with_size(parents: DataFrame, children: DataFrame, key: str, child_key: str, size: str, spellings: Iterable[str], available: Column) -> DataFrame:
    """An available child has one of the spellings of the size."""
    return any_child(parents, children, key, child_key, F.lower(F.trim(F.col(size))).isin([s.lower() for s in spellings]) & available)


def as_number(value) -> float | None:
    """A finite number, also of a request's text; None for anything else."""
    if isinstance(value, bool):
        return None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def cheapest_between(parents: DataFrame, children: DataFrame, key: str, child_key: str, price: str, low=None, high=None) -> DataFrame:
    """The least price over all children lies within the bounds; a bound that is no number, nor text of one, is ignored."""
    low, high = as_number(low), as_number(high)
    if low is None and high is None:
        return parents
    least = children.groupBy(F.col(child_key).alias("__k")).agg(F.min(price).alias("__least"))
    ok = all_of(F.col("__least") >= low if low is not None else None, F.col("__least") <= high if high is not None else None)
    return parents.join(least.where(ok), F.col(key) == F.col("__k"), "left_semi")


def resolved(parents: DataFrame, column: str, value, policy: str) -> DataFrame:
    """Filter by a resolved id. If it didn't resolve (None): 'empty' gives no rows (browsing), 'drop' drops the filter (search, refining)."""
    if value is not None:
        return parents.where(F.col(column) == value)
    return parents.where(F.lit(False)) if policy == "empty" else parents


def not_hidden(test_in_branch: Column, text: Iterable[Column], words: Iterable[str], unless: Iterable[str]) -> Column:
    """Editorial visibility: not (in the branch, one of the words in a text, and none of the exceptions in any)."""
    texts = list(text)
    has = lambda ws: reduce(lambda a, b: a | b, [F.coalesce(t.ilike(f"%{w}%"), F.lit(False)) for t in texts for w in ws], F.lit(False))
    return ~(test_in_branch & has(words) & ~has(unless))


def rule_categories(closed: DataFrame, paths: DataFrame, nodes: DataFrame, rules: list[tuple]) -> DataFrame:
    """category, rules: the categories that each rule reaches, one row a category with the numbers of its rules.

    A rule is (path, reach, names, words, unless); reach is self, below (the node and all below it) or children (those of the
    given names). A path that the tree lacks reaches nothing.
    """
    parts = []
    for i, (path, reach, names, _, _) in enumerate(rules):
        top = paths.where(F.col("path") == path).select(F.col("id").alias("__top"))
        if reach == "below":
            found = closed.join(top, F.col("ancestor_id") == F.col("__top")).select(F.col("descendant_id").alias("category"))
        elif reach == "children":
            found = nodes.where(F.col("name").isin(names)).join(top, F.col("parent_id") == F.col("__top")).select(F.col("id").alias("category"))
        else:
            found = top.select(F.col("__top").alias("category"))
        parts.append(found.withColumn("rule", F.lit(i)))
    return reduce(DataFrame.unionByName, parts).groupBy("category").agg(F.collect_set("rule").alias("rules"))


def hidden_by(rows: DataFrame, category: str, reached: DataFrame, rules: list[tuple], title: str = "title") -> DataFrame:
    """``rows`` with hidden: one of the rules reaches the row's category (``reached`` from ``rule_categories``, small), a text holds one of its words if it has any, and the title none of its exceptions."""
    has = lambda column, words: reduce(lambda a, b: a | b, [F.coalesce(F.col(column).ilike(f"%{w}%"), F.lit(False)) for w in words], F.lit(False))
    met = rows.join(reached.select(F.col("category").alias("__c"), F.col("rules").alias("__rules")), F.col(category) == F.col("__c"), "left")
    hit = F.lit(False)
    for i, (_, _, _, words, unless) in enumerate(rules):
        said = reduce(lambda a, b: a | b, [has(c, w) for c, w in words.items()]) if words else F.lit(True)
        hit = hit | (F.array_contains("__rules", i) & said & ~has(title, unless))
    return met.withColumn("hidden", F.coalesce(hit, F.lit(False))).drop("__c", "__rules")


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among saved ids (one column); ids that name no row are dropped."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias("__k")), F.col(key) == F.col("__k"), "left_semi")
