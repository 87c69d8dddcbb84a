"""Maintenance queries. The two states of the catalog are line items, and the same with prices, stock and rows perturbed by arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import facets, maintain
from quarrymill.plans.tables import table

KEY = ["l_orderkey", "l_partkey", "l_suppkey"]
_CODE = "(l_orderkey * 31 + l_partkey * 7 + l_suppkey) % 100"
_NEW = f"case when {_CODE} < 5 then l_extendedprice + 10 else l_extendedprice end"
_OPEN = f"(l_linestatus = 'O') <> ({_CODE} between 3 and 6)"
_OLD_SQL = f"old as (select l_orderkey, l_partkey, l_suppkey, l_extendedprice as price, l_linestatus = 'O' as available from lineitem where {_CODE} <> 50)"
_NEW_SQL = f"new as (select l_orderkey, l_partkey, l_suppkey, {_NEW} as price, {_OPEN} as available from lineitem where {_CODE} <> 60)"
_ON = "o.l_orderkey = n.l_orderkey and o.l_partkey = n.l_partkey and o.l_suppkey = n.l_suppkey"


def _states(s, d):
    line = table(s, d, "lineitem")
    old = line.where(f"{_CODE} <> 50").select(*KEY, F.col("l_extendedprice").alias("price"), (F.col("l_linestatus") == "O").alias("available"))
    new = line.where(f"{_CODE} <> 60").select(*KEY, F.expr(_NEW).alias("price"), F.expr(_OPEN).alias("available"))
    return old, new


def diff_outcomes(s, d):
    old, new = _states(s, d)
    return maintain.outcomes(old, new, KEY, ["price", "available"])


def nested_outcomes(s, d):
    """Orders as products with their line items as variants: an order is updated by its own content, by an item's price or stock, or by a new item."""
    old, new = _states(s, d)
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("title"))
    before, after = orders.where("l_orderkey % 50 <> 3"), orders.where("l_orderkey % 50 <> 7").withColumn("title", F.expr("if(l_orderkey % 20 = 0, concat(title, '!'), title)"))
    changes = maintain.child_changes(old.where("l_orderkey % 50 <> 3"), new.where("l_orderkey % 50 <> 7"), KEY, ["price", "available"])
    return maintain.nested_outcomes(before, after, ["l_orderkey"], ["title"], changes)


def run_counters(s, d):
    old, new = _states(s, d)
    rows = maintain.outcomes(old, new, KEY, ["price", "available"]).withColumn("store", F.col("l_suppkey") % 10)
    return maintain.run_counters(rows, "store")


def snapshot_changes(s, d):
    old, new = _states(s, d)
    return maintain.snapshots(old, new, KEY, ["price", "available"], F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).drop("observed_at")


def upsert_state(s, d):
    old, new = _states(s, d)
    stamp = lambda x, day: x.withColumn("first_seen", F.lit(day)).withColumn("last_seen", F.lit(day)).withColumn("is_active", F.lit(False))
    return maintain.upsert(stamp(old, "2024-01-01"), stamp(new, "2024-01-02"), KEY, ["price"], ["available"], F.lit("2024-01-02"))


def anti_join_insert_ignore(s, d):
    """Line items as arrivals of parts that the catalog lacks: the first of each part."""
    old = table(s, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"))
    new = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    return maintain.insert_or_ignore(old, new, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


def update_existing_only(s, d):
    old, new = _states(s, d)
    return maintain.update_existing(old, new.where("l_suppkey % 2 = 0"), KEY, ["available"])


def soft_delete(s, d):
    """Stores are nations; a nation whose number divides by 4 failed its run."""
    state = table(s, d, "supplier").select("s_suppkey", "s_nationkey", F.expr("case when s_suppkey % 5 = 0 then '2024-01-01' else '2024-01-03' end").alias("last_seen"), F.lit(True).alias("is_active"))
    runs = table(s, d, "nation").select(F.col("n_nationkey").alias("store"), F.lit("2024-01-02").alias("started_at"), F.expr("if(n_nationkey % 4 = 0, 'failed', 'completed')").alias("status"))
    return maintain.soft_delete(state, "s_nationkey", runs, "last_seen")


def _runs(s, d):
    """Runs of stores from the events: one a user and day, fetched its events, failed if the first was an error."""
    day = F.date_trunc("day", "ts").cast("date").cast("string").alias("day")
    return table(s, d, "events").groupBy("user_id", day).agg(F.count("*").alias("fetched"), F.min_by(F.when(F.col("event_type") == "error", "failed").otherwise("completed"), "event_id").alias("status"))


_RUNS = "runs as (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as fetched, arg_min(case when event_type = 'error' then 'failed' else 'completed' end, event_id) as status from events group by 1, 2)"


def canary_drop(s, d):
    return maintain.canary(_runs(s, d), "user_id", "day", "fetched")


def latest_per_group(s, d):
    return facets.latest_per_group(table(s, d, "events"), ["user_id", "event_type"], ["event_id"], ["event_id", "value"])


def latest_scalar(s, d):
    return table(s, d, "events").where("event_type = 'click'").agg(F.max_by("value", "event_id").alias("value"))


def price_history_scd2(s, d):
    line = table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").groupBy("l_partkey", "l_shipdate").agg(F.min("l_extendedprice").alias("price"))
    return maintain.history(line, ["l_partkey"], "l_shipdate", "price").select("l_partkey", "price", "valid_from", "valid_to", "previous")


def dimension_ids(s, d):
    """New colours get ids behind the known ones; spellings that differ by case and ends are one, the first to arrive."""
    part = table(s, d, "part")
    known = part.where("p_type = 'PROMO' and p_size = 1").select(F.expr("split(p_name, ' ')[0]").alias("name")).distinct().withColumn("id", F.lit(100).cast("long"))
    names = part.select("p_partkey", F.expr("if(p_partkey % 2 = 0, upper(split(p_name, ' ')[1]), concat(' ', split(p_name, ' ')[1]))").alias("name"))
    return maintain.assign_ids(known, names, "name", F.lower(F.trim(F.col("name"))), ["p_partkey"])


def image_lists(s, d):
    """Ordered lists that differ from the old state, twelve at most."""
    line = table(s, d, "lineitem").select("l_partkey", F.concat("l_orderkey", F.lit("-"), "l_suppkey").alias("url"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("position"))
    old = line.where("l_partkey % 4 <> 0")
    return maintain.replace_lists(old, line, "l_partkey", "url", "position").select("l_partkey", "url", F.col("position").cast("long").alias("position"))


def rate_limiter(s, d):
    """Events as hits of their user: two a minute and four a day, as the events are sparse."""
    from quarrymill.streaming.live import limit_rate

    hits = table(s, d, "events").select("event_id", "user_id", "ts")
    return limit_rate(hits, "user_id", "ts", "event_id", per_minute=2, per_day=4).select("event_id", "user_id", "allowed")


QUERIES = {
    "rate_limiter": (rate_limiter, None),
    "diff_outcomes": (diff_outcomes, f"with {_OLD_SQL}, {_NEW_SQL} select coalesce(n.l_orderkey, o.l_orderkey) as l_orderkey, coalesce(n.l_partkey, o.l_partkey) as l_partkey, coalesce(n.l_suppkey, o.l_suppkey) as l_suppkey, case when o.l_orderkey is null then 'new' when n.l_orderkey is null then 'vanished' when o.price = n.price and o.available = n.available then 'unchanged' else 'updated' end as outcome from old o full join new n on {_ON}"),
    "nested_outcomes": (nested_outcomes, f"""with {_OLD_SQL}, {_NEW_SQL},
      c as (select n.l_orderkey, count(*) as children, count(*) filter (o.l_orderkey is null) as new_children, count(*) filter (o.l_orderkey is not null and (o.price <> n.price or o.available <> n.available)) as changed_children
        from (select * from new where l_orderkey % 50 <> 7) n left join (select * from old where l_orderkey % 50 <> 3) o on {_ON} group by 1)
      select o_orderkey as l_orderkey, case when o_orderkey % 50 = 3 then 'new' when o_orderkey % 50 = 7 then 'vanished' when o_orderkey % 20 = 0 or coalesce(new_children + changed_children, 0) > 0 then 'updated' else 'unchanged' end as outcome,
        coalesce(children, 0) as children, coalesce(new_children, 0) as new_children, coalesce(changed_children, 0) as changed_children from orders left join c on o_orderkey = l_orderkey"""),
    "run_counters": (run_counters, f"with {_OLD_SQL}, {_NEW_SQL} select coalesce(n.l_suppkey, o.l_suppkey) % 10 as store, count(*) filter (o.l_orderkey is null) as products_new, count(*) filter (o.l_orderkey is not null and n.l_orderkey is not null and not (o.price = n.price and o.available = n.available)) as products_updated, count(*) filter (o.price = n.price and o.available = n.available) as products_unchanged, count(*) filter (n.l_orderkey is null) as products_removed from old o full join new n on {_ON} group by 1"),
    "snapshot_changes": (snapshot_changes, f"with {_OLD_SQL}, {_NEW_SQL} select n.* from old o join new n on {_ON} where o.price <> n.price or o.available <> n.available"),
    "upsert_state": (upsert_state, f"with {_OLD_SQL}, {_NEW_SQL} select coalesce(n.l_orderkey, o.l_orderkey) as l_orderkey, coalesce(n.l_partkey, o.l_partkey) as l_partkey, coalesce(n.l_suppkey, o.l_suppkey) as l_suppkey, coalesce(n.price, o.price) as price, coalesce(o.available, n.available) as available, case when o.l_orderkey is null then '2024-01-02' else '2024-01-01' end as first_seen, case when n.l_orderkey is null then '2024-01-01' else '2024-01-02' end as last_seen, n.l_orderkey is not null as is_active from old o full join new n on {_ON}"),
    "anti_join_insert_ignore": (anti_join_insert_ignore, "select l_partkey, l_orderkey, l_suppkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 3 = 0) qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) = 1"),
    "update_existing_only": (update_existing_only, f"with {_OLD_SQL}, {_NEW_SQL} select o.l_orderkey, o.l_partkey, o.l_suppkey, o.price, case when n.l_orderkey is null then o.available else n.available end as available from old o left join (select * from new where l_suppkey % 2 = 0) n on {_ON}"),
    "soft_delete": (soft_delete, "select s_suppkey, s_nationkey, case when s_suppkey % 5 = 0 then '2024-01-01' else '2024-01-03' end as last_seen, not (s_nationkey % 4 <> 0 and s_suppkey % 5 = 0) as is_active from supplier"),
    "canary_drop": (canary_drop, f"with {_RUNS}, p as (select *, last_value(case when status = 'completed' then fetched end ignore nulls) over (partition by user_id order by day rows between unbounded preceding and 1 preceding) as prior from runs) select user_id, day, fetched, status, prior, coalesce(fetched > 0 and fetched < prior * 0.7, false) as alert from p"),
    "latest_per_group": (latest_per_group, "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1"),
    "latest_scalar": (latest_scalar, "select value from events where event_type = 'click' order by event_id desc limit 1"),
    "price_history_scd2": (price_history_scd2, "with p as (select l_partkey, l_shipdate, min(l_extendedprice) as price from lineitem group by 1, 2) select l_partkey, price, l_shipdate as valid_from, lead(l_shipdate) over w as valid_to, lag(price) over w as previous from p window w as (partition by l_partkey order by l_shipdate)"),
    "dimension_ids": (dimension_ids, "with n as (select p_partkey, case when p_partkey % 2 = 0 then upper(string_split(p_name, ' ')[2]) else ' ' || string_split(p_name, ' ')[2] end as name from part), f as (select lower(trim(name)) as f, min(p_partkey) as seen, arg_min(trim(name), p_partkey) as name from n group by 1), k as (select distinct lower(string_split(p_name, ' ')[1]) as f from part where p_type = 'PROMO' and p_size = 1) select coalesce((select 100 from k limit 1), 0) + row_number() over (order by seen, f) as id, name from f where f not in (select f from k)"),
    "image_lists": (image_lists, "with l as (select l_partkey, l_orderkey || '-' || l_suppkey as url, l_orderkey * 100 + l_linenumber as p from lineitem where l_partkey % 4 = 0) select l_partkey, url, r - 1 as position from (select *, row_number() over (partition by l_partkey order by p, url) as r from l) where r <= 12"),
}
