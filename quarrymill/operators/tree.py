"""Operators over an adjacency-list tree (id, parent_id, name). Trees are small dimensions: their closure is a recursive query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CLOSURE = """
WITH RECURSIVE up(ancestor_id, descendant_id, depth, path_ids, path) AS (
  SELECT id, id, 0, CAST(lpad(CAST(id AS STRING), 12, '0') AS STRING), CAST(name AS STRING) FROM {nodes}
  UNION ALL
  SELECT u.ancestor_id, n.id, u.depth + 1, concat(u.path_ids, '/', lpad(CAST(n.id AS STRING), 12, '0')), concat(u.path, ' > ', n.name)
  FROM up u JOIN {nodes} n ON n.parent_id = u.descendant_id
)
SELECT ancestor_id, descendant_id, depth, path_ids, path FROM up
"""


def closure(nodes: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, depth (0 for itself), path_ids, path (names from ancestor to descendant)."""
    return nodes.sparkSession.sql(_CLOSURE, nodes=nodes.select("id", "parent_id", "name"))


def descendants(closed: DataFrame, root) -> DataFrame:
    """descendant_id of the node and all below it; of all nodes for None."""
    rows = closed.where("depth = 0") if root is None else closed.where(F.col("ancestor_id") == root)
    return rows.select("descendant_id").distinct()


def rollup(closed: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    """id and the sum of ``n`` over the node and all below it, zero included."""
    met = closed.join(counts, F.col("descendant_id") == F.col(key), "left")
    return met.groupBy(F.col("ancestor_id").alias("id")).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total"))


def paths(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, path and depth of each node from its root."""
    roots = nodes.where("parent_id is null").select(F.col("id").alias("ancestor_id"))
    return closed.join(roots, "ancestor_id").select(F.col("descendant_id").alias("id"), "path", F.col("depth").cast("long").alias("depth"))


def find_descendants(closed: DataFrame, nodes: DataFrame, wanted: DataFrame, root: str, name: str) -> DataFrame:
    """``wanted`` (with a root id and a name) with found: the first node of that name at or below the root, in the preorder that visits the last child first.

    Names are compared trimmed and in lower case; found is null if there is none.
    """
    named = closed.join(nodes.select(F.col("id").alias("descendant_id"), F.lower(F.trim("name")).alias("__name")), "descendant_id")
    order = F.transform(F.split("path_ids", "/"), lambda x: -x.cast("long"))
    met = wanted.join(named, (F.col(root) == F.col("ancestor_id")) & (F.lower(F.trim(F.col(name))) == F.col("__name")), "left")
    return met.groupBy(*wanted.columns).agg(F.min_by("descendant_id", order).alias("found"))


def resolve_path(nodes: DataFrame, closed: DataFrame, levels: list[str | None]) -> int | None:
    """Id of the node that the level names lead to: a direct child at each step, any descendant after a skipped level; None if a step misses.

    The tree is a dimension of a few hundred rows, and each step reads one number.
    """
    at, skipped = None, False
    for name in levels:
        if not name:
            skipped = skipped or at is not None
            continue
        same = F.lower(F.trim("name")) == name.strip().lower()
        if at is None:
            row = nodes.where(F.col("parent_id").isNull() & same).agg(F.min("id")).first()
        elif not skipped:
            row = nodes.where((F.col("parent_id") == at) & same).agg(F.min("id")).first()
        else:
            one = nodes.sparkSession.createDataFrame([(at, name)], "root long, name string")
            row = find_descendants(closed, nodes, one, "root", "name").select("found").first()
        if row is None or row[0] is None:
            return None
        at, skipped = row[0], False
    return at


def prune_ancestors(closed: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """The picked nodes without those that are strict ancestors of another picked one."""
    strict = closed.where("depth > 0").join(picked.select(F.col(key).alias("descendant_id")), "descendant_id").select(F.col("ancestor_id").alias(key)).distinct()
    return picked.join(strict, key, "left_anti")


def expand(closed: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """The distinct nodes at or below the picked ones, as ``key``."""
    return closed.join(picked.select(F.col(key).alias("ancestor_id")), "ancestor_id").select(F.col("descendant_id").alias(key)).distinct()


def resolve_names(nodes: DataFrame, closed: DataFrame, roots: list[str], names: list[str]) -> DataFrame:
    """category_id of what a search names: under each root the first node of each name, without those that are above another one found there, and all below them.

    Without names the whole roots; empty if nothing is found.
    """
    tops = nodes.where(F.col("parent_id").isNull() & F.lower(F.trim("name")).isin([r.strip().lower() for r in roots])).select(F.col("id").alias("root"))
    if not names:
        return expand(closed, tops, "root").withColumnRenamed("root", "category_id")
    wanted = tops.select("root", F.explode(F.array(*[F.lit(n) for n in names])).alias("wanted"))
    found = find_descendants(closed, nodes, wanted, "root", "wanted").where("found is not null").select("root", "found").distinct()
    above = found.select("root", F.col("found").alias("descendant_id")).join(closed.where("depth > 0"), "descendant_id").select("root", F.col("ancestor_id").alias("found")).distinct()
    return expand(closed, found.join(above, ["root", "found"], "left_anti"), "found").withColumnRenamed("found", "category_id")


def orphans(nodes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows that sit on a node with children instead of on a leaf."""
    inner = nodes.where("parent_id is not null").select(F.col("parent_id").alias(key)).distinct()
    return rows.join(inner, key, "left_semi")


def menu(closed: DataFrame, nodes: DataFrame, counts: DataFrame, key: str, n: str, roots: list[str] | None = None, branches: list[str] | None = None, subs: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each root that has rows: id, name, total, place, columns.

    Columns are its branches with rows, nested: place, rank, id, name, total, subs, leaves. They come in the fixed order
    of ``branches`` (others behind it), without one by falling total; roots likewise by ``roots``, which also are the
    only ones then. A branch named in ``subs`` has its next level as subs (place, id, name, total, leaves) in that
    order, any other branch has leaves (id, name, total) only. Ties go to the smaller id. What has no rows is left out.
    """
    place = lambda c, order: order_by_list(c, order) if order else F.lit(1)
    rank = lambda order: F.lit(0).cast("long") if order else -F.col("total")
    rows = nodes.join(rollup(closed, counts, key, n), "id").where("total > 0")
    leaf = rows.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "total"))).alias("leaves")).withColumnRenamed("parent_id", "__p")
    inner = rows.where("parent_id is not null").join(leaf, F.col("id") == F.col("__p"), "left").drop("__p")
    branch = inner.join(nodes.where("parent_id is null").select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    split = F.col("name").isin(list(subs or {}))
    order = F.lit(1)
    for name, fixed in (subs or {}).items():
        order = F.when(F.col("branch") == name, order_by_list(F.col("name"), fixed)).otherwise(order)
    own = branch.where(split).select(F.col("id").alias("__b"), F.col("name").alias("branch"))
    below = inner.join(own, F.col("parent_id") == F.col("__b")).select("__b", F.struct(order.cast("long").alias("place"), "id", "name", "total", "leaves").alias("__s"))
    below = below.groupBy("__b").agg(F.array_sort(F.collect_list("__s")).alias("subs"))
    columns = branch.join(below, F.col("id") == F.col("__b"), "left").select("parent_id", F.struct(place(F.col("name"), branches).cast("long").alias("place"), rank(branches).alias("rank"), "id", "name", "total", "subs", F.when(~split, F.col("leaves")).alias("leaves")).alias("__x"))
    columns = columns.groupBy("parent_id").agg(F.array_sort(F.collect_list("__x")).alias("columns")).withColumnRenamed("parent_id", "__p")
    top = rows.where("parent_id is null")
    if roots:
        top = top.where(F.col("name").isin(roots))
    at = place(F.col("name"), roots).cast("long") if roots else F.row_number().over(Window.orderBy(F.desc("total"), "id")).cast("long")  # a row a root
    return top.join(columns, F.col("id") == F.col("__p"), "left").select("id", "name", "total", at.alias("place"), "columns")


def siblings(menus: DataFrame, root: str, branch: str, leaf: str | None = None) -> DataFrame:
    """name, total of the leaves beside ``leaf`` (itself included) in a branch of ``menu``'s rows: those of its sub level, if the branch has one; without a leaf, of the whole branch."""
    cols = menus.where(F.col("name") == root).select(F.explode("columns").alias("c")).where(F.col("c.name") == branch)
    lists = cols.select(F.explode(F.coalesce(F.transform("c.subs", lambda x: x["leaves"]), F.array("c.leaves"))).alias("l"))
    if leaf is not None:
        lists = lists.where(F.exists("l", lambda x: x["name"] == leaf))
    return lists.select(F.explode("l").alias("x")).select("x.name", "x.total")


def branches_of(closed: DataFrame, nodes: DataFrame, roots: list[str], branches: list[str]) -> DataFrame:
    """id of the nodes in the named branches of the named roots, branches included."""
    tops = nodes.where(F.col("parent_id").isNull() & F.col("name").isin(roots)).select(F.col("id").alias("parent_id"))
    return expand(closed, nodes.where(F.col("name").isin(branches)).join(tops, "parent_id", "left_semi").select("id"), "id")


def order_by_list(column: Column, fixed: list[str]) -> Column:
    """Place of a value in a fixed order; values that aren't in it come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in fixed]), column)
    return F.when(place == 0, len(fixed) + 1).otherwise(place)
