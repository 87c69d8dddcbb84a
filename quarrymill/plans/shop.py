"""Queries of the shop's smaller requests, of its exports and profiles, and of backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import literals, scalars
from quarrymill.operators import enrich, facets, maintain, predicates, telemetry, topk
from quarrymill.plans.tables import table
from quarrymill.plans.upkeep import KEY, _states
from quarrymill.sources import export

def _newest():
    return [F.desc("p_size"), F.desc("p_partkey")]


def viewer_last_page(s, d):
    """A page far beyond the last one shows the last."""
    return topk.clamped_page(table(s, d, "part").select("p_partkey", "p_name"), [F.col("p_partkey")], 10**6)[2]


def resort_pool(s, d):
    """The returned pool again by price, parts without one last."""
    price = F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("price")
    pool = table(s, d, "part").orderBy(*_newest()).limit(60).select("p_partkey", price)
    return topk.resorted(pool, "price", "p_partkey", True).select("p_partkey", "price", "place")


def multi_get(s, d):
    """Saved ids, some of which name no part."""
    saved = table(s, d, "events").select((F.col("event_id") * 7 % 50021).alias("id"))
    return predicates.among(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", saved)


def store_dropdown(s, d):
    return facets.store_counts(table(s, d, "supplier"), "s_nationkey", "s_name")


def search_log_rows(s, d):
    """Events as searches: an error is a category that wasn't found and leaves no row."""
    rows = table(s, d, "events").select("event_id", "user_id", "event_type", "value")
    found = F.when(F.col("event_type") == "view", 0).otherwise(F.col("user_id") % 7)
    return telemetry.log_rows(rows, F.col("event_type") != "error", found, {"tokens": F.col("event_id") % 100}).select("event_id", "user_id", "results", "zero", "tokens")


def export_json(s, d):
    """The export's list as one JSON array."""
    rows = table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    return export.json_array(rows, _newest(), 360)


def color_dimension_filter(s, d):
    """Parts with a line item of a wanted colour, the colours a dimension of their own; one in seven items has no colour, one an unknown one."""
    line = table(s, d, "lineitem").withColumn("color_id", F.expr("case l_suppkey % 7 when 0 then null when 1 then 999 else (l_orderkey + l_linenumber) % 400 end"))
    return predicates.with_color_of(table(s, d, "part").select("p_partkey"), line, literals.colors(s), "p_partkey", "l_partkey", "color_id", ["NAVY", "off-white"], fold=True)


def named_colors(s, d):
    """Line items with the names of their colours, by name."""
    line = table(s, d, "lineitem").select(F.expr("if(l_suppkey % 7 = 0, null, (l_orderkey + l_linenumber) % 25)").alias("color_id"))
    return enrich.named_color(line, literals.colors(s), "color_id").groupBy("color", "hex").agg(F.count("*").alias("n"))


def product_pages(s, d):
    """The viewer's page of each part: its price as text, and images from a list that may be missing, empty or broken."""
    images = F.expr("case p_partkey % 5 when 0 then concat('[\"a', p_partkey, '\", \"b\"]') when 1 then '[]' when 2 then 'broken [' when 3 then null else '[\"x\"]' end")
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("u"), "p_partkey")).when(F.col("p_partkey") % 3 == 0, "")
    return table(s, d, "part").select("p_partkey", scalars.price_text(F.when(F.col("p_size") != 5, F.col("p_retailprice") * 10)).alias("price"), F.array_join(scalars.gallery(images, url), "|").alias("images"))


def profile_report(s, d):
    """The report's lines: parts by type."""
    n = table(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))
    return export.report_lines(n, "types", ["p_type", "n", "brands"], [F.desc("n"), F.col("p_type")])


_OPTIONS = "filter(array(split(p_name, ' ')[0], split(p_name, ' ')[1], if(p_size > 25, 'size', null)), x -> x is not null)"


def profile_option_sets(s, d):
    return facets.option_sets(table(s, d, "part").withColumn("names", F.expr(_OPTIONS)), "p_brand", "names")


def option_names(s, d):
    """Which of a part's option names speak of colour or size."""
    roles = scalars.option_roles(F.expr("array(upper(split(p_name, ' ')[0]), concat(' ', split(p_name, ' ')[1]), 'Size')"), ["red", "blue", "green", "ring", "size"])
    return table(s, d, "part").select("p_partkey", F.array_join(roles, ",").alias("roles"))


def profile_null_shares(s, d):
    rows = table(s, d, "part").select("p_brand", F.when(F.col("p_size") > 10, F.col("p_type")).alias("kind"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("title"), F.col("p_retailprice").alias("price"))
    return facets.null_shares(rows, "p_brand", ["kind", "title", "price"])


def profile_sample_titles(s, d):
    return facets.sample_titles(table(s, d, "part"), "p_brand", "p_type", "p_name", "p_partkey")


def sample_per_store(s, d):
    """A seeded sample of five parts a brand; reruns agree."""
    return topk.sample_per_group(table(s, d, "part"), ["p_brand"], "p_partkey", 5, 7).select("p_partkey", "p_brand", "rn")


def cap_protected(s, d):
    """At most 360 rows, none of the rarer type lost to others."""
    return topk.cap_protecting(table(s, d, "part"), F.col("p_type") == "PROMO", _newest(), 360).select("p_partkey", "p_type")


def featured_filtered(s, d):
    """The featured listing of two types without some parts; the total counts all of them, uncapped."""
    rows = table(s, d, "part").where(F.col("p_type").isin("STANDARD", "PROMO") & (F.col("p_partkey") % 17 != 0))
    total = rows.agg(F.count("*").alias("total"))
    page = topk.featured(rows, "p_brand", _newest(), 10, 12, 24)
    return page.join(F.broadcast(total)).select("p_partkey", "p_brand", "rn", "bp", "total")  # one row


def color_cards(s, d):
    """Colour to availability and first image, as flat rows; every other image is missing."""
    line = table(s, d, "lineitem").withColumn("url", F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_orderkey", F.lit("-"), "l_suppkey")))
    cards = enrich.color_cards(line, "l_partkey", "l_returnflag", F.col("l_linestatus") == "O", F.col("url"), ["l_orderkey", "l_linenumber", "l_suppkey"])
    return cards.select("l_partkey", F.explode("cards").alias("color", "card")).select("l_partkey", "color", "card.available", "card.image")


def run_audit(s, d):
    """All counters of a run: stores are the last digit of the supplier."""
    old, new = _states(s, d)
    store = (F.col("l_suppkey") % 10).alias("store")
    named = lambda df: df.withColumn("store", F.col("l_suppkey") % 10)
    outcome = named(maintain.outcomes(old, new, KEY, ["price", "available"]))
    changed = named(maintain.snapshots(old, new, KEY, ["price", "available"], F.lit(None)))
    excluded, errors = named(new.where("price > 90000")), named(new.where("price < 950"))
    return maintain.audit(table(s, d, "lineitem").select(store), "store", outcome, {"excluded": excluded, "errors": errors, "variants": named(new), "snapshots": changed})


def unknown_updates(s, d):
    """What a targeted update asked for and the state lacks, by store."""
    old, new = _states(s, d)
    rows = maintain.unknown_keys(old, new, KEY)
    return rows.groupBy((F.col("l_suppkey") % 10).alias("store"), "found").agg(F.count("*").alias("n"))


def hide_and_unhide(s, d):
    """Parts hidden by an editorial rule, the number that this changed, and the number that taking it back changes."""
    part = table(s, d, "part").withColumn("shown", F.col("p_size") != 7)
    rule = (F.col("p_type") == "SMALL") & F.col("p_name").ilike("%ring%")
    hidden, n = maintain.set_flag(part, "shown", rule)
    again, back = maintain.set_flag(hidden, "shown", rule, undo=True)
    left = again.agg(F.count_if(~F.col("shown")).alias("hidden_after"))
    return n.select(F.col("n").alias("hides")).join(hidden.agg(F.count_if(~F.col("shown")).alias("hidden"))).join(back.select(F.col("n").alias("shows"))).join(left)  # one row each


def delete_excluded(s, d):
    """Parts that a rule now excludes go from the state, and are reported."""
    part = table(s, d, "part").select("p_partkey", "p_type")
    kept, gone = maintain.without_excluded(part, table(s, d, "part").where("p_name ilike '%gear%'"), ["p_partkey"])
    return kept.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True))).groupBy("p_type", "deleted").agg(F.count("*").alias("n"))


def force_unavailable(s, d):
    """Variants of parts with a tag that takes them out: the history rows of those that were available."""
    out = table(s, d, "part").where(scalars.forced_unavailable(scalars.parse_tags(F.expr("concat(p_name, ', ', if(p_size < 10, ' Cart-Hide ', 'x'))")))).select("p_partkey")
    line = table(s, d, "lineitem").select(*KEY, (F.col("l_linestatus") == "O").alias("available"))
    state, history = maintain.force_unavailable(line, out, "l_partkey", "available", F.lit("2024-02-01").cast("date"))
    open_ = state.groupBy("l_partkey").agg(F.count_if("available").alias("still"))
    return history.groupBy("l_partkey").agg(F.count("*").alias("taken")).join(open_, "l_partkey").select("l_partkey", "taken", "still")


def parts_by_color(s, d):
    """Parts by the colour that their name begins with; a colour without parts counts zero."""
    first = table(s, d, "part").select(F.lower(F.split("p_name", " ")[0]).alias("word"))
    known = literals.colors(s).withColumn("word", F.lower("name"))
    return facets.counts_with_zeros(known, "word", first, "word").select("id", "name", "hex", "n")


_OLD = "old as (select l_orderkey, l_partkey, l_suppkey, l_extendedprice as price, l_linestatus = 'O' as available from lineitem where (l_orderkey * 31 + l_partkey * 7 + l_suppkey) % 100 <> 50)"
_C = "(l_orderkey * 31 + l_partkey * 7 + l_suppkey) % 100"
_NEW = f"new as (select l_orderkey, l_partkey, l_suppkey, case when {_C} < 5 then l_extendedprice + 10 else l_extendedprice end as price, (l_linestatus = 'O') <> ({_C} between 3 and 6) as available from lineitem where {_C} <> 60)"
_ON = "o.l_orderkey = n.l_orderkey and o.l_partkey = n.l_partkey and o.l_suppkey = n.l_suppkey"
_SET = "list_sort(list_distinct(case when p_size > 25 then [string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], 'size'] else [string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]] end))"

QUERIES = {
    "parts_by_color": (parts_by_color, "with c as (select * from (values " + ", ".join(f"({i}::bigint, '{n}', '{h}')" for i, (n, h) in enumerate(literals.COLORS, 1)) + ") t(id, name, hex)) select id, name, hex, count(p_partkey) as n from c left join part on lower(string_split(p_name, ' ')[1]) = lower(name) group by all"),
    "viewer_last_page": (viewer_last_page, "select p_partkey, p_name from part order by p_partkey limit 48 offset (select (ceil(count(*) / 48.0)::bigint - 1) * 48 from part)"),
    "resort_pool": (resort_pool, "with p as (select p_partkey, case when p_size % 5 <> 0 then p_retailprice end as price from part order by p_size desc, p_partkey desc limit 60) select *, row_number() over (order by price desc nulls last, p_partkey) as place from p"),
    "multi_get": (multi_get, "select p_partkey, p_name from part where p_partkey in (select event_id * 7 % 50021 from events)"),
    "store_dropdown": (store_dropdown, "select s_nationkey, count(*) as n, max(s_name) as shown from supplier group by 1"),
    "search_log_rows": (search_log_rows, "select event_id, user_id, r::bigint as results, r = 0 as zero, event_id % 100 as tokens from (select *, case when event_type = 'view' then 0 else user_id % 7 end as r from events) where event_type <> 'error'"),
    "export_json": (export_json, "select to_json(list({p_partkey: p_partkey, p_brand: p_brand, p_size: p_size} order by p_size desc, p_partkey desc))::varchar as json from (select p_partkey, p_brand, p_size from part order by p_size desc, p_partkey desc limit 360)"),
    "profile_report": (profile_report, "with n as (select p_type, count(*) as n, count(distinct p_brand) as brands from part group by 1) select '== types: p_type, n, brands' as value, 0::bigint as place union all select concat_ws('  ', p_type, n::varchar, brands::varchar), row_number() over (order by n desc, p_type) from n"),
    "profile_option_sets": (profile_option_sets, f"with n as (select p_brand, array_to_string({_SET}, ' + ') as names, count(*) as n from part group by 1, 2) select * from (select p_brand, names, n, row_number() over (partition by p_brand order by n desc, names) as rn from n) where rn <= 8"),
    "option_names": (option_names, "select p_partkey, concat_ws(',', case when string_split(p_name, ' ')[1] in ('red', 'blue', 'green', 'ring') then string_split(p_name, ' ')[1] end, case when string_split(p_name, ' ')[2] in ('red', 'blue', 'green', 'ring') and string_split(p_name, ' ')[2] <> string_split(p_name, ' ')[1] then string_split(p_name, ' ')[2] end, 'size') as roles from part"),
    "profile_null_shares": (profile_null_shares, "select p_brand, round(avg(case when p_size > 10 then 0.0 else 100.0 end::double), 6) as kind, round(avg(case when p_partkey % 3 = 0 then 100.0 else 0.0 end::double), 6) as title, 0.0::double as price from part group by 1"),
    "profile_sample_titles": (profile_sample_titles, "with k as (select p_brand, p_type from (select p_brand, p_type, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by 1, 2) where r <= 3) select p_brand, p_type, p_name, rn from (select p_brand, p_type, p_name, row_number() over (partition by p_brand, p_type order by p_partkey) as rn from part join k using (p_brand, p_type)) where rn <= 8"),
    "sample_per_store": (sample_per_store, "select p_partkey, p_brand, rn from (select p_partkey, p_brand, row_number() over (partition by p_brand order by md5('7:' || p_partkey), p_partkey) as rn from part) where rn <= 5"),
    "cap_protected": (cap_protected, "select p_partkey, p_type from part order by case when p_type = 'PROMO' then 0 else 1 end, p_size desc, p_partkey desc limit 360"),
    "featured_filtered": (featured_filtered, """with f as (select * from part where p_type in ('STANDARD', 'PROMO') and p_partkey % 17 <> 0),
      c as (select p_partkey, p_brand, row_number() over (order by p_size desc, p_partkey desc) as pos from (select *, row_number() over (partition by p_brand order by p_size desc, p_partkey desc) as r from f) where r <= 10)
      select p_partkey, p_brand, rn, bp, (select count(*) from f) as total from (select p_partkey, p_brand, row_number() over (partition by p_brand order by pos) as rn, min(pos) over (partition by p_brand) as bp from c) order by rn, bp limit 24 offset 12"""),
    "color_cards": (color_cards, "select l_partkey, l_returnflag as color, bool_or(l_linestatus = 'O') as available, arg_min(l_orderkey || '-' || l_suppkey, {a: l_orderkey, b: l_linenumber, c: l_suppkey}) filter (l_linenumber % 2 = 0) as image from lineitem group by 1, 2"),
    "run_audit": (run_audit, f"""with {_OLD}, {_NEW}, st as (select distinct l_suppkey % 10 as store from lineitem),
      m as (select coalesce(n.l_suppkey, o.l_suppkey) % 10 as store, o.l_orderkey is null as fresh, n.l_orderkey is null as gone, o.price = n.price and o.available = n.available as same from old o full join new n on {_ON}),
      c as (select store, count(*) filter (fresh) as a, count(*) filter (not fresh and not gone and not same) as b, count(*) filter (same) as c, count(*) filter (gone) as d from m group by 1),
      v as (select l_suppkey % 10 as store, count(*) filter (price > 90000) as excluded, count(*) filter (price < 950) as errors, count(*) as variants from new group by 1)
      select store, coalesce(a, 0) as products_new, coalesce(b, 0) as products_updated, coalesce(c, 0) as products_unchanged, coalesce(d, 0) as products_removed, coalesce(excluded, 0) as excluded, coalesce(errors, 0) as errors, coalesce(variants, 0) as variants, coalesce(b, 0) as snapshots from st left join c using (store) left join v using (store)"""),
    "unknown_updates": (unknown_updates, f"with {_OLD}, {_NEW}, k as (select distinct l_orderkey, l_partkey, l_suppkey from new), j as (select distinct l_orderkey, l_partkey, l_suppkey from old) select k.l_suppkey % 10 as store, j.l_orderkey is not null as found, count(*) as n from k left join j on k.l_orderkey = j.l_orderkey and k.l_partkey = j.l_partkey and k.l_suppkey = j.l_suppkey group by 1, 2"),
    "color_dimension_filter": (color_dimension_filter, f"with colors(id, name) as (values {', '.join(f"({i}, '{n}')" for i, (n, _) in enumerate(literals.COLORS, 1))}), l as (select l_partkey, case l_suppkey % 7 when 0 then null when 1 then 999 else (l_orderkey + l_linenumber) % 400 end as color_id from lineitem) select p_partkey from part where exists (select 1 from l join colors c on c.id = l.color_id where l_partkey = p_partkey and lower(c.name) in ('navy', 'off-white'))"),
    "named_colors": (named_colors, f"with colors(id, name, hex) as (values {', '.join(f"({i}, '{n}', '{h}')" for i, (n, h) in enumerate(literals.COLORS, 1))}) select name as color, hex, count(*) as n from (select case when l_suppkey % 7 <> 0 then (l_orderkey + l_linenumber) % 25 end as color_id from lineitem) left join colors on id = color_id group by 1, 2"),
    "product_pages": (product_pages, "select p_partkey, case when p_size <> 5 then 'Rs. ' || format('{:,}', floor(p_retailprice * 10 + 0.5)::bigint) else '' end as price, case when p_partkey % 5 = 0 then 'a' || p_partkey || '|b' when p_partkey % 5 = 4 then 'x' when p_partkey % 2 = 0 then 'u' || p_partkey else '' end as images from part"),
    "hide_and_unhide": (hide_and_unhide, "with r as (select p_size <> 7 as shown, p_type = 'SMALL' and p_name ilike '%ring%' as hit from part) select count(*) filter (hit and shown) as hides, count(*) filter (hit or not shown) as hidden, count(*) filter (hit) as shows, count(*) filter (not hit and not shown) as hidden_after from r"),
    "delete_excluded": (delete_excluded, "select p_type, p_name ilike '%gear%' as deleted, count(*) as n from part group by 1, 2"),
    "force_unavailable": (force_unavailable, "select l_partkey, count(*) as taken, 0::bigint as still from lineitem join part on l_partkey = p_partkey where p_size < 10 and l_linestatus = 'O' group by 1"),
}
