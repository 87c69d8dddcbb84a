"""Browsing queries: filters, listings, enrichment, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators import enrich, facets, predicates, topk
from quarrymill.plans.tables import table

TIE = ["l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
_CHEAP = "arg_min({v: l_extendedprice, d: l_discount}, {a: l_extendedprice is null, b: l_extendedprice, c: l_orderkey, d: l_suppkey, e: l_linenumber})"


def _open():
    return F.col("l_linestatus") == "O"


def _summary(s, d) -> DataFrame:
    """p_partkey, in stock, least price and the cheapest variant of each product: one aggregation serves every test and the page."""
    best = enrich.cheapest_child(table(s, d, "lineitem"), "l_partkey", "l_extendedprice", ["l_extendedprice", "l_discount"], ["l_orderkey", "l_suppkey", "l_linenumber"], _open())
    return best.withColumnRenamed("l_partkey", "p_partkey")


def _refined(s, d) -> DataFrame:
    """Products in stock whose cheapest variant costs up to 10,000, with that variant."""
    return table(s, d, "part").join(_summary(s, d).where("any_available and l_extendedprice <= 10000"), "p_partkey")


_REFINED = """refined as (
  select p.* from part p where exists (select 1 from lineitem where l_partkey = p_partkey and l_linestatus = 'O')
  and (select min(l_extendedprice) from lineitem where l_partkey = p_partkey) <= 10000)"""


def browse_interleaved_page(s, d):
    """Rank narrow, page, then join the wide columns; the cheapest variant comes along with the test of the products."""
    narrow = _refined(s, d).select("p_partkey", "p_brand", "p_size", "l_extendedprice", "l_discount", "any_available", "n_children")
    page = topk.interleave(narrow, "p_brand", [F.desc("p_size"), F.desc("p_partkey")], 24, 24).drop("p_brand", "p_size")
    wide = enrich.late_join(F.broadcast(page), table(s, d, "part"), "p_partkey")  # the page is at most 24 rows
    return wide.select("p_partkey", "p_name", "p_brand", "rn", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), "any_available", "n_children")


def _page_sql(order, page="limit 24"):
    return f"with {_REFINED} select p_partkey, p_name, p_brand, p_size, p_retailprice from refined order by {order} {page}"


def _listed(sort):
    def run(s, d):
        refined = _refined(s, d)
        offset, limit = topk.page_bounds("1", "24")
        return refined.orderBy(*topk.listing_order(sort, "p_retailprice", "p_size", "p_partkey")).offset(offset).limit(limit).select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")

    return run


def browse_ilike(s, d):
    part = table(s, d, "part")
    return part.where(predicates.all_of(predicates.matches("p_name", "RING"), F.col("p_size") > 5)).select("p_partkey", "p_name")


def filter_on_sale(s, d):
    part, line = table(s, d, "part"), table(s, d, "lineitem")
    return predicates.on_sale(part, line, "p_partkey", "l_partkey", F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_discount"))).select("p_partkey")


def filter_color_exact(s, d):
    return predicates.with_color(table(s, d, "part"), table(s, d, "lineitem"), "p_partkey", "l_partkey", "l_returnflag", ["R", "a"]).select("p_partkey")


def filter_color_lower(s, d):
    return predicates.with_color(table(s, d, "part"), table(s, d, "lineitem").withColumn("color", F.expr(_SHADE)), "p_partkey", "l_partkey", "color", ["R", "a"], fold=True).select("p_partkey")


#: Colours of a variant: the flag of a few, a shade of the others.
_SHADE = "if(cast(l_quantity as int) = 50, l_returnflag, concat('shade ', cast(l_quantity as int) % 10))"
#: Sizes of a variant as labels, to have spellings that mean the same.
_LABEL = "case cast(l_quantity as int) % 8 when 0 then 'XS' when 1 then 'small' when 2 then 'S' when 3 then 'Medium' when 4 then ' m ' when 5 then 'L' when 6 then '2XL' else 'L-XL' end"

#: The same for variants of which few have a label with other spellings.
_RARE_LABEL = f"case when l_quantity < 5 then {_LABEL} else 'size ' || cast(l_quantity as int) end"


def filter_size_alias(s, d):
    from quarrymill.functions.scalars import size_spellings

    line = table(s, d, "lineitem").withColumn("label", F.expr(_RARE_LABEL))
    return predicates.with_size(table(s, d, "part"), line, "p_partkey", "l_partkey", "label", size_spellings(["m", "XXL"]), _open()).select("p_partkey")


def filter_in_stock(s, d):
    return predicates.any_child(table(s, d, "part"), table(s, d, "lineitem"), "p_partkey", "l_partkey", _open()).select("p_partkey")


def filter_price_range(s, d):
    return predicates.cheapest_between(table(s, d, "part"), table(s, d, "lineitem"), "p_partkey", "l_partkey", "l_extendedprice", 1500, 4000).select("p_partkey")


def filter_independent_exists(s, d):
    """Size and colour may be met by different variants."""
    part, line = table(s, d, "part"), table(s, d, "lineitem")
    a = predicates.any_child(part, line, "p_partkey", "l_partkey", (F.col("l_quantity") == 7) & _open())
    return predicates.any_child(a, line, "p_partkey", "l_partkey", F.col("l_returnflag") == "R").select("p_partkey")


def array_membership(s, d):
    return table(s, d, "part").where(F.array_contains(F.array(F.lit("Brand#1"), F.lit("Brand#7")), F.col("p_brand")) & ~F.col("p_size").isin(1, 2, 3)).select("p_partkey", "p_brand", "p_size")


def unresolved_brand(s, d):
    """The three policies for a brand that didn't resolve: rows that each leaves."""
    part = table(s, d, "part")
    rows = [predicates.resolved(part, "p_brand", v, p).agg(F.count("*").alias("n")).select(F.lit(n).alias("policy"), "n") for n, v, p in (("browse", None, "empty"), ("search", None, "drop"), ("resolved", "Brand#1", "empty"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def hidden_products(s, d):
    text = [F.col("p_name"), F.col("p_type")]
    return table(s, d, "part").where(~predicates.not_hidden(F.col("p_size") < 25, text, ["ring", "gear"], ["blue"])).select("p_partkey")


def cheapest_variant(s, d):
    best = enrich.cheapest_child(table(s, d, "lineitem"), "l_partkey", "l_extendedprice", ["l_extendedprice", "l_discount"], ["l_orderkey", "l_suppkey", "l_linenumber"], _open())
    return best.select("l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), "any_available", "n_children")


def cheapest_compare_at(s, d):
    """The cheapest variant's compare-at price, shown only if above the price; per cent off."""
    from quarrymill.functions.scalars import discount_per_cent

    line = table(s, d, "lineitem").withColumn("compare_at", F.when(F.col("l_discount") > 0.03, F.floor(F.col("l_extendedprice") * 125 + 0.5) / 100))
    best = enrich.cheapest_child(line, "l_partkey", "l_extendedprice", ["l_extendedprice", "compare_at"], ["l_orderkey", "l_suppkey", "l_linenumber"], _open())
    shown = F.when(F.col("compare_at") > F.col("l_extendedprice"), F.col("compare_at"))
    return best.select("l_partkey", shown.alias("compare_at"), discount_per_cent(F.col("l_extendedprice"), F.col("compare_at")).alias("per_cent_off"))


def lateral_top1(s, d):
    """The cheapest variant in its lateral form, as SQL; of variants at one price the first by order, supplier and line, as everywhere.

    The subquery selects what it orders by: with a projection between the order and the limit Spark ranks a part's rows in a window
    without an order, and which row comes first is left to the shuffle.
    """
    s.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("lateral_part")
    s.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lateral_line")
    return s.sql("""select p_partkey, v.l_extendedprice as price from lateral_part,
      lateral (select l_extendedprice, l_orderkey, l_suppkey, l_linenumber from lateral_line where l_partkey = p_partkey order by l_extendedprice asc nulls last, l_orderkey, l_suppkey, l_linenumber limit 1) v""")


def first_child_coalesce(s, d):
    """The first image (here: order) of the wanted colour, else the first."""
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    return enrich.first_match_or_first(part, table(s, d, "lineitem"), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber", "l_suppkey"], F.col("l_returnflag") == "R", "image")


def left_join_counts(s, d):
    nation = table(s, d, "nation")
    return facets.counts_with_zeros(nation, "n_nationkey", table(s, d, "supplier").where("s_acctbal > 9000"), "s_nationkey").select("n_nationkey", "n_name", "n")


def fallback_chain_lookup(s, d):
    """Leaf, else branch, else root: a supplier, else its nation, else its region."""
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    rich = table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("v"))
    even = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("v"))
    region = table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("v"))
    return enrich.fallback_lookup(sup, [(rich, [("s_suppkey", "k")], "v"), (even, [("s_nationkey", "k")], "v"), (region, [("n_regionkey", "k")], "v")], "found").select("s_suppkey", "found")


def related_products(s, d):
    """For each product, five others of its brand and type: the newest six, itself left out."""
    part = table(s, d, "part")
    six = topk.cap_per_group(part, ["p_brand", "p_type"], [F.desc("p_size"), F.desc("p_partkey")], 6).select(F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_partkey").alias("other"), "rn")
    met = part.join(six, (F.col("p_brand") == F.col("b")) & (F.col("p_type") == F.col("t")) & (F.col("p_partkey") != F.col("other"))).select("p_partkey", "other", F.col("rn").alias("r0"))
    return topk.cap_per_group(met, ["p_partkey"], [F.col("r0")], 5).select("p_partkey", "other", "rn")


def nested_size_availability(s, d):
    """Colour to size to availability maps, shown as flat rows."""
    line = table(s, d, "lineitem").withColumn("size", F.col("l_quantity").cast("int"))
    maps = enrich.availability_maps(line, "l_partkey", "l_returnflag", "size", _open())
    flat = maps.select("l_partkey", F.explode("by_color").alias("color", "sizes")).select("l_partkey", "color", F.explode("sizes").alias("size", "ok"))
    return flat


def facet_brand(s, d):
    refined = _refined(s, d)
    return facets.counts(refined, "p_brand")


def facet_total(s, d):
    refined = _refined(s, d)
    return refined.agg(F.count("*").alias("n"))


def facet_size_distinct(s, d):
    return facets.distinct_counts(table(s, d, "lineitem").where("l_linestatus = 'O'").withColumn("size", F.expr(_LABEL)), "size", "l_partkey")


def _merged(exact):
    def run(s, d):
        from quarrymill.functions.scalars import canonical_size

        line = table(s, d, "lineitem").where("l_linestatus = 'O'").withColumn("size", F.expr(_LABEL))
        return facets.merged_counts(line, "size", canonical_size(F.col("size")), "l_partkey", exact, 16).select("size", F.col("n").cast("long").alias("n"))

    return run


def facet_color_top12(s, d):
    return facets.distinct_counts(table(s, d, "lineitem"), "l_returnflag", "l_partkey").orderBy(F.desc("n"), "l_returnflag").limit(12)


def price_bounds(s, d):
    return facets.bounds(table(s, d, "lineitem").where("l_linestatus = 'O'"), "l_extendedprice")


def cap_per_brand(s, d):
    return topk.cap_per_group(table(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.desc("p_partkey")], 8).orderBy(F.desc("p_retailprice"), F.desc("p_partkey")).limit(60).select("p_partkey", "p_brand", "rn")


def featured_round_robin(s, d):
    """Newest ten a brand, in the order of newness, then one brand after the other."""
    rows = topk.cap_per_group(table(s, d, "part"), ["p_brand"], [F.desc("p_size"), F.desc("p_partkey")], 10, "__r").drop("__r")
    rows = rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("p_size"), F.desc("p_partkey"))).cast("long"))  # ten a brand at most
    turned = topk.round_robin(rows, "p_brand", "pos")
    return turned.orderBy("rn", "bp").limit(48).select("p_partkey", "p_brand", "rn", "bp")


def diversify_two_level(s, d):
    top = table(s, d, "part").orderBy(F.desc("p_retailprice"), F.desc("p_partkey")).limit(120)
    return topk.diversify(top, "p_type", "p_brand", [F.desc("p_retailprice"), F.desc("p_partkey")]).select("p_partkey", "place")


_SHUFFLE = "(p_partkey * 7919 + 13) % 10007"


def sample_diverse_pick(s, d):
    """At most two of each brand and type first; shuffled by a portable hash."""
    rows = table(s, d, "part").withColumn("h", F.expr(_SHUFFLE))
    return topk.diverse_pick(rows, ["p_brand", "p_type"], [F.col("h"), F.col("p_partkey")], 2, 120).select("p_partkey", "rn")


def coverage_top_up(s, d):
    """A picked list with at least five products of each type."""
    rows = table(s, d, "part").withColumn("h", F.expr(_SHUFFLE))
    picked = rows.where("h < 60")
    return topk.coverage_top_up(picked, rows, "p_partkey", "p_type", 5, [F.col("h"), F.col("p_partkey")]).select("p_partkey", "p_type")


def order_fixed_list(s, d):
    from quarrymill.operators.tree import order_by_list

    place = order_by_list(F.col("p_type"), ["STANDARD", "SMALL", "PROMO"]).cast("long")
    return table(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).select("p_type", "n", place.alias("place"))


_CH = f"select l_partkey, {_CHEAP} as x, bool_or(l_linestatus = 'O') as any_available, count(*) as n_children from lineitem group by l_partkey"
_SPELL = "('m','medium','xxl','2xl','xx-large','xxlarge')"
_CANON = "case lower(trim(size)) when 'small' then 'S' when 's' then 'S' when 'xs' then 'XS' when 'm' then 'M' when 'medium' then 'M' when 'l' then 'L' when '2xl' then 'XXL' else trim(size) end"
_SIZED = f"sized as (select *, {_LABEL} as size from lineitem where l_linestatus = 'O')"

QUERIES = {
    "browse_interleaved_page": (browse_interleaved_page, f"""with {_REFINED}, ranked as (
      select p_partkey, p_brand, row_number() over (partition by p_brand order by p_size desc, p_partkey desc) as rn from refined),
      page as (select * from ranked order by rn, p_brand limit 24 offset 24), best as ({_CH})
      select g.p_partkey, p.p_name, p.p_brand, g.rn, x.v as price, x.d as discount, any_available, n_children
      from page g join part p using (p_partkey) join best b on b.l_partkey = g.p_partkey"""),
    "browse_price_asc": (_listed("price_asc"), _page_sql("p_retailprice asc nulls last, p_partkey")),
    "browse_price_desc": (_listed("price_desc"), _page_sql("p_retailprice desc nulls last, p_partkey")),
    "browse_newest": (_listed("newest"), _page_sql("p_size desc nulls last, p_partkey desc")),
    "browse_by_id": (_listed("unknown"), _page_sql("p_partkey")),
    "browse_ilike": (browse_ilike, "select p_partkey, p_name from part where p_name ilike '%RING%' and p_size > 5"),
    "filter_on_sale": (filter_on_sale, "select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_extendedprice * (1 + l_discount) > l_extendedprice)"),
    "filter_color_exact": (filter_color_exact, "select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag in ('R', 'a'))"),
    "filter_color_lower": (filter_color_lower, "select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and lower(case when l_quantity::int = 50 then l_returnflag else 'shade ' || (l_quantity::int % 10) end) in ('r', 'a'))"),
    "filter_size_alias": (filter_size_alias, f"select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_linestatus = 'O' and lower(trim({_RARE_LABEL})) in {_SPELL})"),
    "filter_in_stock": (filter_in_stock, "select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_linestatus = 'O')"),
    "filter_price_range": (filter_price_range, "select p_partkey from part where (select min(l_extendedprice) from lineitem where l_partkey = p_partkey) between 1500 and 4000"),
    "filter_independent_exists": (filter_independent_exists, "select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity = 7 and l_linestatus = 'O') and exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')"),
    "array_membership": (array_membership, "select p_partkey, p_brand, p_size from part where p_brand = any(['Brand#1', 'Brand#7']) and p_size not in (1, 2, 3)"),
    "unresolved_brand": (unresolved_brand, "select 'browse' as policy, 0::bigint as n union all select 'search', count(*) from part union all select 'resolved', count(*) from part where p_brand = 'Brand#1'"),
    "hidden_products": (hidden_products, "select p_partkey from part where p_size < 25 and (p_name ilike '%ring%' or p_name ilike '%gear%' or p_type ilike '%ring%' or p_type ilike '%gear%') and not (p_name ilike '%blue%' or p_type ilike '%blue%')"),
    "cheapest_variant": (cheapest_variant, f"select l_partkey, x.v as price, x.d as discount, any_available, n_children from ({_CH})"),
    "cheapest_compare_at": (cheapest_compare_at, "select l_partkey, case when c > v then c end as compare_at, case when c > v then floor((c - v) / c * 100 + 0.5)::bigint end as per_cent_off from (select l_partkey, x.v as v, case when x.d > 0.03 then floor(x.v * 125 + 0.5) / 100 end as c from (" + _CH + "))"),
    "lateral_top1": (lateral_top1, "select p_partkey, v.l_extendedprice as price from part, lateral (select l_extendedprice from lineitem where l_partkey = p_partkey order by l_extendedprice asc nulls last, l_orderkey, l_suppkey, l_linenumber limit 1) v"),
    "first_child_coalesce": (first_child_coalesce, "select p_partkey as l_partkey, coalesce(arg_min(l_suppkey, {a: l_orderkey, b: l_linenumber, c: l_suppkey}) filter (l_returnflag = 'R'), arg_min(l_suppkey, {a: l_orderkey, b: l_linenumber, c: l_suppkey})) as image from part left join lineitem on l_partkey = p_partkey group by p_partkey"),
    "left_join_counts": (left_join_counts, "select n_nationkey, n_name, count(s_suppkey) as n from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000 group by all"),
    "fallback_chain_lookup": (fallback_chain_lookup, "select s_suppkey, case when s_acctbal > 5000 then 's' || s_suppkey when n_nationkey % 2 = 0 then 'n' || n_nationkey else 'r' || n_regionkey end as found from supplier join nation on s_nationkey = n_nationkey"),
    "related_products": (related_products, """with six as (select * from (select p_brand, p_type, p_partkey as other, row_number() over (partition by p_brand, p_type order by p_size desc, p_partkey desc) as r0 from part) where r0 <= 6)
      select p_partkey, other, rn from (select p.p_partkey, other, row_number() over (partition by p.p_partkey order by r0) as rn from part p join six s on p.p_brand = s.p_brand and p.p_type = s.p_type and p.p_partkey <> other) where rn <= 5"""),
    "nested_size_availability": (nested_size_availability, "select l_partkey, l_returnflag as color, l_quantity::int as size, bool_or(l_linestatus = 'O') as ok from lineitem group by all"),
    "facet_brand": (facet_brand, f"with {_REFINED} select p_brand, count(*) as n from refined group by p_brand"),
    "facet_total": (facet_total, f"with {_REFINED} select count(*) as n from refined"),
    "facet_size_distinct": (facet_size_distinct, f"with {_SIZED} select size, count(distinct l_partkey) as n from sized group by size"),
    "facet_size_merged_top16": (_merged(False), f"with {_SIZED}, c as (select size, count(distinct l_partkey) as n from sized group by size), m as (select {_CANON} as k, sum(n)::bigint as n from c group by 1) select k as size, n from m order by n desc, k limit 16"),
    "facet_size_exact_top16": (_merged(True), f"with {_SIZED}, c as (select {_CANON} as k, l_partkey from sized), m as (select k, count(distinct l_partkey) as n from c group by 1) select k as size, n from m order by n desc, k limit 16"),
    "facet_color_top12": (facet_color_top12, "select l_returnflag, count(distinct l_partkey) as n from lineitem group by 1 order by n desc, l_returnflag limit 12"),
    "price_bounds": (price_bounds, "select min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem where l_linestatus = 'O'"),
    "cap_per_brand": (cap_per_brand, "select p_partkey, p_brand, rn from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey desc) as rn from part) where rn <= 8 order by p_retailprice desc, p_partkey desc limit 60"),
    "featured_round_robin": (featured_round_robin, """with c as (select p_partkey, p_brand, row_number() over (order by p_size desc, p_partkey desc) as pos from (select *, row_number() over (partition by p_brand order by p_size desc, p_partkey desc) as r from part) where r <= 10)
      select p_partkey, p_brand, row_number() over (partition by p_brand order by pos) as rn, min(pos) over (partition by p_brand) as bp from c order by rn, bp limit 48"""),
    "diversify_two_level": (diversify_two_level, """with t as (select p_partkey, p_type as c, p_brand as b, row_number() over (order by p_retailprice desc, p_partkey desc) as pos from part order by p_retailprice desc, p_partkey desc limit 120),
      r as (select *, row_number() over (partition by c, b order by pos) as rb, min(pos) over (partition by c, b) as bp, min(pos) over (partition by c) as cp from t),
      k as (select *, row_number() over (partition by c order by rb, bp) as k from r)
      select p_partkey, place from (select p_partkey, row_number() over (order by k, cp) as place from k) where place <= 50"""),
    "sample_diverse_pick": (sample_diverse_pick, f"with t as (select p_partkey, {_SHUFFLE} as h, row_number() over (partition by p_brand, p_type order by {_SHUFFLE}, p_partkey) as rn from part) select p_partkey, rn from t where rn <= 120 order by (rn > 2)::int, h, p_partkey limit 120"),
    "coverage_top_up": (coverage_top_up, f"""with r as (select p_partkey, p_type, {_SHUFFLE} as h from part), k as (select * from r where h < 60),
      n as (select p_type, count(*) as n from k group by 1), x as (select r.p_partkey, r.p_type, 5 - coalesce(n.n, 0) as lack, row_number() over (partition by r.p_type order by h, r.p_partkey) as rn from r left join n on r.p_type = n.p_type where h >= 60)
      select p_partkey, p_type from k union all select p_partkey, p_type from x where lack > 0 and rn <= lack"""),
    "order_fixed_list": (order_fixed_list, "select p_type, count(*) as n, case p_type when 'STANDARD' then 1 when 'SMALL' then 2 when 'PROMO' then 3 else 4 end::bigint as place from part group by p_type"),
}
