"""Taxonomy queries over the region-nation-supplier tree; a supplier's count is its variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions.literals import values
from quarrymill.operators import tree
from quarrymill.plans.tables import CLOSURE_SQL, NODES_SQL, nodes, table


def _counts(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_suppkey") + 1000).alias("k")).agg(F.count("*").alias("n"))


_COUNTS = "counts as (select l_suppkey + 1000 as k, count(*) as n from lineitem group by 1)"
_TOTAL = f"{CLOSURE_SQL}, {_COUNTS}, total as (select ancestor_id as id, coalesce(sum(n), 0)::bigint as total from closed left join counts on descendant_id = k group by 1)"


def tree_closure(s, d):
    return tree.closure(nodes(s, d)).select("ancestor_id", "descendant_id", F.col("depth").cast("long").alias("depth"))


def tree_rollup_counts(s, d):
    return tree.rollup(tree.closure(nodes(s, d)), _counts(s, d), "k", "n")


def tree_paths(s, d):
    t = nodes(s, d)
    return tree.paths(tree.closure(t), t)


def _names(n_max=3):
    return " union all ".join(f"select {r} as root, 'x{r}' as tag, '{n}' as name" for r, n in [(1, " nation_0 "), (1, "AFRICA"), (2, "Supplier#000000001"), (3, "nothing"), (104, "supplier#000000002")])


def _duplicate_names(t):
    """The tree with names that repeat, so that the order of the search matters."""
    return t.withColumn("name", F.when(F.col("id") >= 1000, F.concat(F.lit("Leaf "), F.col("id") % 7)).otherwise(F.col("name")))


def tree_find_descendant(s, d):
    t = _duplicate_names(nodes(s, d))
    wanted = s.range(1, 6).select(F.col("id").alias("root")).join(s.range(0, 7).select(F.concat(F.lit(" leaf "), F.col("id")).alias("name")))
    return tree.find_descendants(tree.closure(t), t, wanted, "root", "name")


def tree_prune_ancestors(s, d):
    """Picked nodes, their ancestors pruned, expanded to all below."""
    t = nodes(s, d)
    closed = tree.closure(t)
    picked = t.where("id in (1, 2, 101, 102, 1003, 1010, 1011)").select("id")
    return tree.expand(closed, tree.prune_ancestors(closed, picked, "id"), "id")


def tree_orphans(s, d):
    t = nodes(s, d)
    rows = table(s, d, "part").select("p_partkey", F.expr("case when p_partkey % 11 = 0 then 100 + p_partkey % 25 when p_partkey % 13 = 0 then 1 + p_partkey % 5 else 1000 + p_partkey % 10 end").cast("long").alias("category"))
    return tree.orphans(t.withColumnRenamed("parent_id", "parent_id"), rows, "category")


#: Orders of the test's menu: some roots, some branches first, and one branch that is shown with its next level.
_ROOTS, _BRANCHES = ["MIDDLE EAST", "AFRICA", "EUROPE"], ["NATION_7", "NATION_2", "NATION_11"]


def _menu(s, d, roots=None, branches=None, subs=None):
    t = nodes(s, d)
    return tree.menu(tree.closure(t), t, _counts(s, d), "k", "n", roots, branches, subs)


def _flat(menus):
    cols = menus.select(F.col("name").alias("root"), F.col("total").alias("root_total"), F.col("place").alias("root_place"), F.posexplode("columns").alias("i", "c"))
    rows = cols.select("root", "root_total", "root_place", F.col("c.name").alias("branch"), F.col("c.total").alias("branch_total"), (F.col("i") + 1).cast("long").alias("branch_place"), F.posexplode_outer("c.leaves").alias("j", "l"))
    return rows.select("root", "root_total", "root_place", "branch", "branch_total", "branch_place", F.col("l.name").alias("leaf"), F.col("l.total").alias("leaf_total"), (F.col("j") + 1).cast("long").alias("leaf_place"))


def tree_menu(s, d):
    """The nested menu by falling totals, shown as flat rows with their places."""
    return _flat(_menu(s, d))


def tree_menu_fixed(s, d):
    """The menu of some roots in a fixed order, branches likewise, those that aren't listed behind."""
    return _flat(_menu(s, d, _ROOTS, _BRANCHES))


def menu_siblings(s, d):
    """The leaves beside one, from the menu."""
    menus = _menu(s, d)
    return tree.siblings(menus, "AMERICA", "NATION_1", "Supplier#000000008").unionByName(tree.siblings(menus, "ASIA", "NATION_2")).select("name", "total")


def featured_categories(s, d):
    """All nodes in two branches of two roots, as a listing's category filter."""
    t = nodes(s, d)
    names = t.where("parent_id is not null and id < 1000 and id % 3 = 0")
    return tree.branches_of(tree.closure(t), t, ["AFRICA", "ASIA"], [f"NATION_{i}" for i in (0, 2, 5, 12)]).join(names.select(F.col("id").alias("x")), F.col("id") == F.col("x"), "left").select("id", F.col("x").isNotNull().alias("third"))


def featured_cards(s, d):
    """Cards 'root:name' with the node found, its own count and first product; those without rows are dropped."""
    t = nodes(s, d)
    spec = [(f"{r}:{n}",) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST") for n in ("Supplier#000000003", "Supplier#000000004", "none")]
    cards = values(s, spec, ["card"])
    cards = cards.select("card", F.split("card", ":")[0].alias("root_name"), F.split("card", ":")[1].alias("name"))
    roots = t.where("parent_id is null").select(F.col("id").alias("root"), F.col("name").alias("root_name"))
    found = tree.find_descendants(tree.closure(t), t, cards.join(roots, "root_name"), "root", "name").where("found is not null")
    line = table(s, d, "lineitem").groupBy((F.col("l_suppkey") + 1000).alias("found")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("image"))
    return found.join(line, "found").select("card", "found", "n", "image")


_FLAT_SQL = """top as (select *, {at} as place from r where parent_id is null and {root}),
      b as (select b.*, row_number() over (partition by b.parent_id order by {branch}) as place from r b),
      l as (select *, row_number() over (partition by parent_id order by id) as place from r)
      select top.name as root, top.total as root_total, top.place as root_place, b.name as branch, b.total as branch_total, b.place as branch_place, l.name as leaf, l.total as leaf_total, l.place as leaf_place
      from top join b on b.parent_id = top.id left join l on l.parent_id = b.id"""

QUERIES = {
    "tree_closure": (tree_closure, f"with recursive {CLOSURE_SQL} select ancestor_id, descendant_id, depth::bigint as depth from closed"),
    "tree_rollup_counts": (tree_rollup_counts, f"with recursive {_TOTAL} select id, total from total"),
    "tree_paths": (tree_paths, f"with recursive {CLOSURE_SQL} select descendant_id as id, path, depth::bigint as depth from closed where ancestor_id in (select id from nodes where parent_id is null)"),
    "tree_find_descendant": (tree_find_descendant, f"with recursive {CLOSURE_SQL}, named as (select id, lower(trim(case when id >= 1000 then 'Leaf ' || (id % 7) else name end)) as nm from nodes), wanted as (select r.range as root, ' leaf ' || k.range as name from range(1, 6) r, range(0, 7) k) select root, name, (select arg_min(descendant_id, path_ids) from closed join named on descendant_id = id where ancestor_id = root and nm = lower(trim(name))) as found from wanted"),
    "tree_prune_ancestors": (tree_prune_ancestors, f"with recursive {CLOSURE_SQL}, picked as (select id from nodes where id in (1, 2, 101, 102, 1003, 1010, 1011)), kept as (select id from picked where id not in (select ancestor_id from closed where depth > 0 and descendant_id in (select id from picked))) select distinct descendant_id as id from closed where ancestor_id in (select id from kept)"),
    "tree_orphans": (tree_orphans, f"with {NODES_SQL} select category, p_partkey from (select p_partkey, (case when p_partkey % 11 = 0 then 100 + p_partkey % 25 when p_partkey % 13 = 0 then 1 + p_partkey % 5 else 1000 + p_partkey % 10 end)::bigint as category from part) where category in (select parent_id from nodes)"),
    "tree_menu": (tree_menu, f"""with recursive {_TOTAL}, r as (select n.id, n.parent_id, n.name, t.total from nodes n join total t using (id) where t.total > 0), {_FLAT_SQL.format(root="true", at="row_number() over (order by total desc, id)", branch="b.total desc, b.id")}"""),
    "tree_menu_fixed": (tree_menu_fixed, f"""with recursive {_TOTAL}, r as (select n.id, n.parent_id, n.name, t.total from nodes n join total t using (id) where t.total > 0), {_FLAT_SQL.format(root="name in ('MIDDLE EAST', 'AFRICA', 'EUROPE')", at="case name when 'MIDDLE EAST' then 1 when 'AFRICA' then 2 else 3 end", branch="case b.name when 'NATION_7' then 1 when 'NATION_2' then 2 when 'NATION_11' then 3 else 4 end, b.id")}"""),
    "menu_siblings": (menu_siblings, f"""with recursive {_TOTAL}, r as (select n.id, n.parent_id, n.name, t.total from nodes n join total t using (id) where t.total > 0)
      select l.name, l.total from r l join r b on l.parent_id = b.id join r a on b.parent_id = a.id where (a.name = 'AMERICA' and b.name = 'NATION_1' and exists (select 1 from r x where x.parent_id = b.id and x.name = 'Supplier#000000008')) or (a.name = 'ASIA' and b.name = 'NATION_2')"""),
    "featured_categories": (featured_categories, f"with recursive {CLOSURE_SQL} select distinct descendant_id as id, descendant_id < 1000 and descendant_id % 3 = 0 as third from closed where ancestor_id in (select b.id from nodes b join nodes a on b.parent_id = a.id where a.parent_id is null and a.name in ('AFRICA', 'ASIA') and b.name in ('NATION_0', 'NATION_2', 'NATION_5', 'NATION_12'))"),
    "featured_cards": (featured_cards, "select r_name || ':' || s_name as card, s_suppkey + 1000 as found, count(*) as n, min(l_partkey) as image from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on r_regionkey = n_regionkey where s_suppkey in (3, 4) group by 1, 2"),
}
