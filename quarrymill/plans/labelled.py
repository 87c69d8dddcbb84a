"""Both classifiers against a table of labels, and option values as colours and sizes against a table of their own.

The labels were printed by the classifiers and then reviewed against the rules, the prototype's title by title, the main
classifier's in part. The oracles look them up and know nothing of the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import categories
from quarrymill.functions import classify as c
from quarrymill.functions import prototype
from quarrymill.operators import enrich, predicates, tree
from quarrymill.plans.classified import TITLES
from quarrymill.plans.tables import table
from quarrymill.session import spread

#: A title, its class (- for no product), and its class by the prototype: gender/branch/sub/leaf, - for none.
LABELS = """
Basic Polo | Unisex/Western/Upperwear/Polo | Unisex/Western/Upperwear/Polo Shirt
Ribbed Tank Top | Unisex/Western/Upperwear/Tank Top | Unisex/Western/Upperwear/T-Shirt
Crew Tee | Unisex/Western/Upperwear/T-Shirt | Unisex/Western/Upperwear/T-Shirt
Vest Tee | Unisex/Western/Upperwear/Tank Top | Unisex/Western/Upperwear/T-Shirt
Quilted Gilet | Unisex/Western/Upperwear/Vest | Unisex/Western/Upperwear/Apparel
Zip Hoodie | Unisex/Western/Upperwear/Hoodie | Unisex/Western/Upperwear/Hoodie
Jacket With Hoodie | Unisex/Western/Upperwear/Jacket | Unisex/Western/Upperwear/Hoodie
Sweat Shirt Plain | Unisex/Western/Upperwear/Sweatshirt | Unisex/Western/Upperwear/Shirt
Turtleneck Knit | Unisex/Western/Upperwear/Sweater | Unisex/Western/Upperwear/Apparel
Printed Tunic | Unisex/Western/Upperwear/Shirt | Unisex/Western/Upperwear/Apparel
Leather Jacket | Unisex/Western/Upperwear/Jacket | Women/Western/Upperwear/Jacket
Wool Coat | Unisex/Western/Upperwear/Jacket | Unisex/Western/Upperwear/Shirt
Maxi Dress | Unisex/Western/Upperwear/Dress | Unisex/Western/Suits & Sets/Dress
Dress Shirt | Unisex/Western/Upperwear/Shirt | Unisex/Western/Suits & Sets/Dress
Hooded Top | Unisex/Western/Upperwear/Hoodie | Unisex/Western/Upperwear/Top
Hooded Check Shirt | Unisex/Western/Upperwear/Shirt | Unisex/Western/Upperwear/Shirt
Gym Vest | Unisex/Western/Upperwear/Tank Top | Unisex/Western/Upperwear/Apparel
Knit Vest | Unisex/Western/Upperwear/Tank Top | Unisex/Western/Upperwear/Apparel
Puffer Vest | Unisex/Western/Upperwear/Vest | Unisex/Western/Upperwear/Apparel
Sando Vest | Unisex/Accessories/-/Underwear | Unisex/Western/Upperwear/Apparel
Oxford Shirt | Unisex/Western/Upperwear/Shirt | Unisex/Western/Upperwear/Shirt
Cargo Shorts | Unisex/Western/Bottomwear/Shorts | Unisex/Western/Bottomwear/Shorts
Cargo Trouser | Unisex/Western/Bottomwear/Cargo Trouser | Unisex/Western/Bottomwear/Trouser
Barrel Jeans | Unisex/Western/Bottomwear/Jeans | Unisex/Western/Bottomwear/Jeans
Blue Denim | Unisex/Western/Bottomwear/Jeans | Unisex/Western/Upperwear/Shirt
Denim Jacket | Unisex/Western/Upperwear/Jacket | Unisex/Western/Upperwear/Jacket
Denim Terry Set | Unisex/Western/Upperwear/Shirt | Unisex/Western/Upperwear/Shirt
Chino Pants | Unisex/Western/Bottomwear/Trouser | Unisex/Western/Bottomwear/Chino
Short Sleeve Shirt | Unisex/Western/Upperwear/Shirt | Unisex/Western/Bottomwear/Shorts
Short Block Heels | Unisex/Western/Footwear/Shoes | Unisex/Western/Bottomwear/Shorts
Running Joggers | Unisex/Western/Bottomwear/Joggers | Unisex/Western/Bottomwear/Jogger
Joggers Shoes | Unisex/Western/Bottomwear/Joggers | Unisex/Western/Footwear/Shoes
Sports Trainers | Unisex/Western/Footwear/Shoes | Unisex/Western/Upperwear/Apparel
Women Sandals | Women/Western/Footwear/Sandals | Women/Western/Footwear/Sandals
Slippers T-Shirt | Unisex/Western/Upperwear/T-Shirt | Unisex/Western/Upperwear/T-Shirt
Gym Tights | Unisex/Western/Bottomwear/Tights | Unisex/Western/Upperwear/Apparel
Pleated Skirt | Unisex/Western/Bottomwear/Skirt | Unisex/Western/Upperwear/Apparel
Denim Jumpsuit | Unisex/Western/Bottomwear/Jeans | Unisex/Western/Suits & Sets/Dress
Hoodie Tracksuit | Unisex/Western/Suits & Sets/Tracksuit | Unisex/Western/Upperwear/Hoodie
Tracksuit Zipper Jacket | Unisex/Western/Upperwear/Jacket | Unisex/Western/Upperwear/Jacket
Three Piece Suit | Unisex/Western/Suits & Sets/Co-ord Set | Unisex/Western/Suits & Sets/Formal Suit
Plain Shirt 2PC | Unisex/Western/Suits & Sets/Co-ord Set | Unisex/Western/Upperwear/Shirt
Co-ord Linen | Unisex/Western/Suits & Sets/Co-ord Set | Unisex/Western/Suits & Sets/Co-ord Set
Combo Hoodie | Unisex/Western/Upperwear/Hoodie | Unisex/Western/Upperwear/Hoodie
Combo Pack | Unisex/Western/Suits & Sets/Co-ord Set | Unisex/Western/Upperwear/Apparel
Formal Suit Navy | Unisex/Western/Suits & Sets/Co-ord Set | Unisex/Western/Suits & Sets/Formal Suit
Linen Blazers Suit | Unisex/Western/Suits & Sets/Co-ord Set | Unisex/Western/Suits & Sets/Blazer
Prince Coat Suit | Unisex/Eastern/Stitched/Sherwani | Unisex/Western/Suits & Sets/Formal Suit
Kurta Shalwar | Unisex/Eastern/Stitched/Kurta Set | Unisex/Eastern/Stitched/Kurta Set
Kurta | Unisex/Eastern/Stitched/Kurta | Unisex/Eastern/Stitched/Kurta
Kurti Printed | Unisex/Eastern/Stitched/Kurti | Unisex/Eastern/Stitched/Kurti
Shalwar Kameez | Unisex/Eastern/Stitched/Shalwar Kameez | Unisex/Eastern/Stitched/Shalwar Kameez
Lehenga Choli | Unisex/Eastern/Stitched/Kurta Set | Unisex/Western/Upperwear/Apparel
Silk Saree | Unisex/Eastern/Stitched/Saree | Unisex/Western/Upperwear/Apparel
Sherwani Gold | Unisex/Eastern/Stitched/Sherwani | Unisex/Eastern/Stitched/Sherwani
Waistcoat Festive | Unisex/Eastern/Stitched/Waistcoat | Unisex/Western/Suits & Sets/Waistcoat Suit
Faux Leather Waistcoat | Unisex/Western/Upperwear/Vest | Women/Western/Suits & Sets/Waistcoat Suit
Unstitched Lawn 3 Piece | Unisex/Eastern/Unstitched/3-Piece | Unisex/Eastern/Unstitched/3-Piece
Unstitched Shirt Dupatta | Unisex/Eastern/Unstitched/2-Piece | Unisex/Eastern/Unstitched/Dupatta & Shawl
Un-stitched Cloth | Unisex/Eastern/Unstitched/Suit | Unisex/Western/Upperwear/Apparel
Shirt Trousers Lawn | Unisex/Eastern/Stitched/Kurta Set | Unisex/Eastern/Stitched/Kurta
Printed Dupatta | Unisex/Accessories/-/Scarf | Unisex/Accessories/-/Scarves & Stoles
Wool Scarf | Unisex/Accessories/-/Scarf | Unisex/Accessories/-/Scarves & Stoles
Leather Belt | Unisex/Accessories/-/Belt | Women/Accessories/-/Belts
Silk Tie | Unisex/Accessories/-/Tie | Unisex/Accessories/-/Ties
Waist Tie Top | Unisex/Western/Upperwear/Shirt | Unisex/Western/Upperwear/Top
Tie Dye Tee | Unisex/Western/Upperwear/T-Shirt | Unisex/Western/Upperwear/T-Shirt
Baseball Cap | Unisex/Accessories/-/Cap | Unisex/Accessories/-/Caps & Hats
Cap Sleeve Tee | Unisex/Western/Upperwear/T-Shirt | Unisex/Western/Upperwear/T-Shirt
Steel Watch | Unisex/Accessories/-/Watch | Unisex/Accessories/-/Watches
Black Watch Shirt | Unisex/Western/Upperwear/Shirt | Unisex/Western/Upperwear/Shirt
Tote Bags | Unisex/Accessories/-/Bag | Unisex/Accessories/-/Bags
Paper Bag Jeans | Unisex/Western/Bottomwear/Jeans | Unisex/Accessories/-/Bags
Bifold Wallet | Unisex/Accessories/-/Wallet | Unisex/Accessories/-/Bags
Ankle Socks | Unisex/Accessories/-/Socks | Unisex/Accessories/-/Socks
Sock-Fit Boots | Unisex/Western/Footwear/Shoes | Unisex/Accessories/-/Socks
Shawl | Unisex/Accessories/-/Shawl | Unisex/Accessories/-/Scarves & Stoles
Shawl Collar Sweater | Unisex/Western/Upperwear/Sweater | Unisex/Western/Upperwear/Sweater
Jeans With Belt Detail | Unisex/Western/Bottomwear/Jeans | Unisex/Accessories/-/Belts
Pocket Square | Unisex/Accessories/-/Pocket Square | Unisex/Western/Upperwear/Apparel
Keychain | Unisex/Accessories/-/Keychain | Unisex/Western/Upperwear/Apparel
Cufflinks | Unisex/Accessories/-/Cufflink | Unisex/Accessories/-/Cufflinks
Sunglasses | Unisex/Accessories/-/Sunglasses | Unisex/Accessories/-/Sunglasses
Silver Necklace | Unisex/Accessories/-/Jewelry | Unisex/Western/Upperwear/Apparel
Eau Perfume | Unisex/Fragrance & Beauty/-/Perfume | Unisex/Fragrance & Beauty/-/Perfume
Boxers | Unisex/Accessories/-/Underwear | Unisex/Western/Upperwear/Apparel
Undergarment Vest | Unisex/Accessories/-/Underwear | Unisex/Western/Upperwear/Apparel
Gift Card | - | Unisex/Western/Upperwear/Apparel
Test | - | Unisex/Western/Upperwear/Apparel
Shopping Bag | - | Unisex/Accessories/-/Bags
Girls Frock | Girls/Western/Upperwear/Dress | Girls/Western/Suits & Sets/Dress
Men Kurti | Women/Eastern/Stitched/Kurti | Men/Eastern/Stitched/Kurti
Open Knit Vest | Unisex/Western/Upperwear/Sweater | Unisex/Western/Upperwear/Apparel
""".strip()
#: A value, whether it looks like a size (s) or a colour (c) or is a placeholder (p), and its label.
VALUES = """
XL | s | XL
xxl | s | XXL
m | s | M
Free Size | s | Free Size
30 | s | 30
40.5 | s | 40.5
7-8 | s | 7-8
12Y | s | 12y
100 ML | s | 100ml
9M-12M | s | 9M-12M
NAVY BLUE | c | Navy Blue
Navy blue | c | Navy blue
OFF-WHITE | c | Off-White
Mint Green | c | Mint Green
charcoal | c | charcoal
Red/Black | c | Red/Black
Rose | - | Rose
Stripes | - | Stripes
SKY | - | Sky
Tangerine | - | Tangerine
L/XL | - | L/Xl
Default Title | p | -
default | p | -
""".strip()


def _split(block: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in block.split("\n")]


def _title(rows):
    return rows.withColumn("title", F.element_at(F.array(*[F.lit(x) for x in TITLES]), (F.col("p_partkey") % len(TITLES) + 1).cast("int")))


def classify_labelled(s, d):
    """The classifier over titles, described by the parts' names and sold by their brands; excluded rows have nulls."""
    rows = _title(spread(table(s, d, "part"), "p_partkey")).select("p_partkey", "title", F.lit("").alias("product_type"), F.lit("").alias("tags"), F.col("p_brand").alias("vendor"), F.lit(None).cast("string").alias("store"), F.col("p_name").alias("description"), F.lit(False).alias("kids_sizing"))
    return c.classify(rows).select("p_partkey", *[F.col(f"class.{x}").alias(x) for x in ("gender", "branch", "sub", "leaf")])


def category_tree(s, d):
    """Every node of the category tree with its parent's path, and the parts that the classifier puts there or below, by the tree's stable ids."""
    nodes = categories.categories(s)
    found = _placed(s, d, nodes).groupBy("category_id").agg(F.count("*").alias("n"))
    total = tree.rollup(tree.closure(nodes), found, "category_id", "n")
    above = nodes.select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
    return nodes.join(above, "parent_id", "left").join(total, "id").select("path", "above", "slug", F.col("level").cast("long").alias("level"), "is_leaf", "total")


def _placed(s, d, nodes):
    """The labelled titles as products, the vendor saying for whom, with the category of their class: its leaf, else its branch, else its gender."""
    who = F.element_at(F.array(*[F.lit(x) for x in ("", "Men", "Women", "Boys", "Girls")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = _title(table(s, d, "part")).select("p_partkey", "title", "p_name", F.lit("").alias("product_type"), F.lit("").alias("tags"), who.alias("vendor"), F.lit(None).cast("string").alias("store"), F.lit("").alias("description"), F.lit(False).alias("kids_sizing"))
    # a part is few bytes and some hundred patterns: parts are dealt out before they meet the rules
    named = c.products(spread(rows, "p_partkey")).select("p_partkey", "title", "p_name", "class.gender", "class.branch", "class.sub", "class.leaf").withColumn("none", F.lit(None).cast("string"))
    leaves = categories.leaves(nodes)
    ways = [[("gender", "gender"), (b, "branch"), (x, "sub"), (y, "leaf")] for b, x, y in (("branch", "sub", "leaf"), ("branch", "none", "none"), ("none", "none", "none"))]
    return enrich.fallback_lookup(named, [(leaves, way, "category_id") for way in ways], "category_id")


def classes_without_leaf(s, d):
    """The audit: classes of the labelled titles that the tree has no leaf for."""
    return categories.unplaced(_placed(s, d, categories.categories(s)), categories.categories(s))


def editorial_hide(s, d):
    """What editors hide, by the category's path, words and exceptions; the part's name stands for the raw text."""
    nodes = categories.categories(s)
    closed = tree.closure(nodes)
    reached = predicates.rule_categories(closed, nodes, nodes, categories.HIDDEN)
    said = F.element_at(F.array(*[F.lit(x) for x in ("", "A Sleeveless cut", "cropped hem", "spaghetti straps", "long")]), (F.col("p_partkey") % 7 % 5 + 1).cast("int"))
    title = F.when(F.col("p_partkey") % 11 == 0, F.concat("title", F.lit(" Crop"))).otherwise(F.col("title"))
    rows = _placed(s, d, nodes).withColumn("title", title).withColumn("description", said).withColumnRenamed("p_name", "raw")
    return predicates.hidden_by(rows, "category_id", reached, categories.HIDDEN).select("p_partkey", "hidden")


def prototype_labelled(s, d):
    """The prototype's classifier over the same titles, every third one from a store of men's wear."""
    store = F.when(F.col("p_partkey") % 3 == 0, "monark").otherwise("other")
    found = prototype.classify_prototype(F.lit(None).cast("string"), F.col("title"), F.lit(""), F.col("p_brand"), store)
    return _title(table(s, d, "part")).select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


def option_axes(s, d):
    """Colours and sizes of each part from options as its line items give them; what the option Title means is voted on by part."""
    v = [x[0] for x in _split(VALUES)]
    at = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    titled = F.when(F.col("l_partkey") % 4 == 0, at(v[:10], F.col("l_suppkey"))).when(F.col("l_partkey") % 4 == 1, at(v[10:17], F.col("l_suppkey"))).otherwise(at(v[8:], F.col("l_suppkey")))
    name = at([" Color", "Shoe Size", "Title", "TITLE ", "Fit", "Size Color"], F.col("l_linenumber"))
    value = F.when(F.col("l_suppkey") % 13 == 0, None).when(F.lower(F.trim(name)) == "title", titled).otherwise(at(v, F.col("l_suppkey") + F.col("l_linenumber")))
    pair = F.struct("l_orderkey", "l_suppkey", name.alias("name"), value.alias("value"))
    rows = table(s, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    axes = prototype.option_axes(F.col("pairs"))
    return rows.select("l_partkey", axes.alias("x")).select("l_partkey", F.array_join("x.colors", "|").alias("colors"), F.array_join("x.sizes", "|").alias("sizes"))


def _values(rows: list[list[str | None]]) -> str:
    text = lambda x: "null" if x is None or x == "-" else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(map(text, r))})" for i, r in enumerate(rows))


def _labels(which: int, names: str) -> str:
    rows = [(x[which].split("/") if x[which] != "-" else [None] * 4) for x in _split(LABELS)]
    return f"labels(i, {names}) as (values {_values(rows)})"


def _option_sql() -> str:
    v = _split(VALUES)
    n = len(v)
    return f"""
with v(i, value, kind, label) as (values {_values([[a, b, c_] for a, b, c_ in v])}),
lines as (select *, ([' Color', 'Shoe Size', 'Title', 'TITLE ', 'Fit', 'Size Color'])[l_linenumber % 6 + 1] as name from lineitem),
places as (select l_partkey, l_orderkey, l_suppkey, lower(trim(name)) as name, case when l_suppkey % 13 = 0 then null when lower(trim(name)) = 'title' then
    case l_partkey % 4 when 0 then l_suppkey % 10 when 1 then 10 + l_suppkey % 7 else 8 + l_suppkey % {n - 8} end else (l_suppkey + l_linenumber) % {n} end as at from lines),
pairs as (select p.*, kind, label from places p join v on p.at = v.i where kind is distinct from 'p'),
votes as (select l_partkey, case when 2 * count(*) filter (kind = 's') >= count(*) then 's' when 2 * count(*) filter (kind = 'c') >= count(*) then 'c' end as vote from pairs where name = 'title' group by 1),
axes as (select p.*, case when contains(name, 'color') then 'c' when contains(name, 'size') then 's' when name = 'title' then vote end as axis from pairs p left join votes using (l_partkey)),
once as (select *, row_number() over (partition by l_partkey, axis, lower(label) order by name = 'title', l_orderkey, l_suppkey) as k from axes where axis is not null),
lists as (select l_partkey, axis, string_agg(label, '|' order by name = 'title', l_orderkey, l_suppkey) as labels from once where k = 1 group by 1, 2)
select l_partkey, coalesce(max(labels) filter (axis = 'c'), '') as colors, coalesce(max(labels) filter (axis = 's'), '') as sizes
from (select distinct l_partkey from lineitem) left join lists using (l_partkey) group by 1
"""


def _placed_sql() -> str:
    """The labelled titles with the path of their category: by hand made labels, and whom the vendor names."""
    letters = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in categories.GENDERS.items()) + ") as g(letter, gender)"
    return f"""tree as (select gender, branch, nullif(sub, '-') as sub, leaf from (values {", ".join(f"('{a}', '{b or '-'}', '{leaf}', '{g}')" for a, b, leaf, g in categories.leaf_rows())}) as l(branch, sub, leaf, letters), {letters} where contains(letters, letter)),
  nodes as (select distinct concat_ws(' > ', gender, branch, sub, leaf) as path, gender, branch, sub, leaf, true as is_leaf from tree
    union select distinct concat_ws(' > ', gender, branch, sub), gender, branch, sub, null, false from tree union select distinct concat_ws(' > ', gender, branch), gender, branch, null, null, false from tree union select distinct gender, gender, null, null, null, false from tree),
  {_labels(1, "gender, branch, sub, leaf")},
  named as (select p_partkey, p_name, i, branch, sub, leaf, case when leaf = 'Kurti' and who in ('Men', 'Women') then 'Women' when leaf = 'Kurti' and who in ('Boys', 'Girls') then 'Girls'
      when who is not null then who else gender end as gender from (select *, ([null, 'Men', 'Women', 'Boys', 'Girls'])[p_partkey % 5 + 1] as who from part) p join labels on p_partkey % {len(TITLES)} = i where branch is not null),
  -- what the label of a title becomes for some genders
  made as (select p_partkey, p_name, i, gender, branch, case when t = 'Formal Suit Navy' and gender in ('Men', 'Boys') or t = 'Linen Blazers Suit' and gender in ('Men', 'Boys') then 'Formalwear' else sub end as sub,
      case when t in ('Formal Suit Navy', 'Linen Blazers Suit') and gender in ('Men', 'Boys') then 'Formal Suit' when t = 'Women Sandals' and gender <> 'Women' then 'Shoes' when t = 'Printed Tunic' and gender in ('Women', 'Girls') then 'Top' else leaf end as leaf
    from named join (values {", ".join(f"({k}, '{t}')" for k, t in enumerate(TITLES))}) as titles(k, t) on i = k),
  placed as (select m.*, coalesce(a.path, b.path, m.gender) as path from made m
    left join nodes a on a.is_leaf and a.gender = m.gender and a.branch = m.branch and a.sub is not distinct from m.sub and a.leaf = m.leaf
    left join nodes b on not b.is_leaf and b.sub is null and b.gender = m.gender and b.branch = m.branch)"""


_SAID = "(['', 'A Sleeveless cut', 'cropped hem', 'spaghetti straps', 'long'])[p_partkey % 7 % 5 + 1]"
QUERIES = {
    "category_tree": (category_tree, f"""with {_placed_sql()}, uppers as (select path, nullif(regexp_replace(path, '( > )?[^>]+$', ''), '') as above from nodes)
      select n.path, u.above, case when is_leaf then replace(lower(leaf), ' ', '-') else regexp_replace(lower(coalesce(sub, branch, gender)), '[^a-z]+', '-', 'g') end as slug,
        len(string_split(n.path, ' > '))::bigint as level, is_leaf, (select count(*) from placed p where p.path = n.path or starts_with(p.path, n.path || ' > ')) as total from nodes n join uppers u using (path)"""),
    "classes_without_leaf": (classes_without_leaf, f"with {_placed_sql()} select gender, branch, sub, leaf, count(*) as n from made m where not exists (select 1 from tree t where t.gender = m.gender and t.branch = m.branch and t.sub is not distinct from m.sub and t.leaf = m.leaf) group by all"),
    "editorial_hide": (editorial_hide, f"""with {_placed_sql()}, r as (select p_partkey, path, t || case when p_partkey % 11 = 0 then ' Crop' else '' end as title, {_SAID} as d from placed join (values {", ".join(f"({k}, '{t}')" for k, t in enumerate(TITLES))}) as titles(k, t) on i = k)
      select p_partkey, path in ('Women > Western > Bottomwear > Shorts', 'Women > Western > Bottomwear > Tights', 'Women > Accessories > Underwear', 'Women > Western > Upperwear > Tank Top')
        or (path = 'Women' or starts_with(path, 'Women > ')) and d in ('A Sleeveless cut', 'spaghetti straps') and not regexp_matches(title, '(?i)vest|gilet|bodywarmer')
        or regexp_matches(path, '^Women > Western > Upperwear > (Shirt|T-Shirt|Sweatshirt|Hoodie|Sweater|Polo)$') and (title ilike '%crop%' or d = 'cropped hem') as hidden from r"""),
    "classify_labelled": (classify_labelled, f"with {_labels(1, 'gender, branch, sub, leaf')} select p_partkey, gender, branch, sub, leaf from part join labels on p_partkey % {len(TITLES)} = i"),
    "prototype_labelled": (prototype_labelled, f"with {_labels(2, 'gender, branch, sub, category')} select p_partkey, case when gender = 'Unisex' and p_partkey % 3 = 0 then 'Men' else gender end as gender, branch, sub, category from part join labels on p_partkey % {len(TITLES)} = i"),
    "option_axes": (option_axes, _option_sql()),
}
