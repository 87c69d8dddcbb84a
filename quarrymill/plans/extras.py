"""Smaller queries: swatches, lists of another source, first of equals, addresses, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import enrich
from quarrymill.plans.tables import table

_COLORS = "case p_partkey % 5 when 0 then 'Red' when 1 then 'SKY BLUE' when 2 then 'navy' when 3 then 'plaid' end"


def color_swatches(s, d):
    return table(s, d, "part").select("p_partkey", scalars.color_hex(F.expr(_COLORS)).alias("hex"))


def cross_source_lists(s, d):
    """Suppliers of a part from a source that numbers its parts twice as high, as a list; parts that it lacks get an empty one."""
    other = table(s, d, "lineitem").groupBy((F.col("l_partkey") * 2).alias("p_partkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))
    rows = enrich.attach_lists(table(s, d, "part").select("p_partkey"), other, ["p_partkey"], ["suppliers"])
    return rows.select("p_partkey", F.array_join(F.transform("suppliers", lambda x: x.cast("string")), ",").alias("suppliers"), "missed")


def dedupe_keep_first(s, d):
    """The first part of each name, whatever its case."""
    rows = table(s, d, "part").withColumn("p_name", F.expr("if(p_partkey % 2 = 0, upper(p_name), p_name)"))
    return enrich.keep_first(rows, F.lower("p_name"), ["p_partkey"]).select("p_partkey", "p_name")


def decoded_text(s, d):
    """Tags away, then the common entities decoded."""
    return table(s, d, "pages").select("page_id", scalars.decode_entities(scalars.strip_html(F.col("html"))).alias("text"))


def email_check(s, d):
    address = F.expr("case p_partkey % 4 when 0 then concat(' ', split(p_name, ' ')[0], '@x.org ') when 1 then p_name when 2 then concat(split(p_name, ' ')[0], '@', p_type) else null end")
    return table(s, d, "part").select("p_partkey", scalars.valid_email(address).alias("ok"))


_SPACES = r"[\s\x{00A0}\x0B\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FLAT = f"nullif(substring(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_SPACES}', ' ', 'g')), 1, 2000), '')"

QUERIES = {
    "color_swatches": (color_swatches, f"select p_partkey, case lower({_COLORS}) when 'red' then '#b23a2e' when 'sky blue' then '#8ec6e6' when 'navy' then '#1c2a4a' else '#a89f8f' end as hex from part"),
    "cross_source_lists": (cross_source_lists, "with o as (select l_partkey * 2 as l_partkey, list_sort(list_distinct(list(l_suppkey))) as s from lineitem group by 1) select p_partkey, coalesce(array_to_string(s, ','), '') as suppliers, s is null as missed from part left join o on l_partkey = p_partkey"),
    "dedupe_keep_first": (dedupe_keep_first, "select p_partkey, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as p_name from part qualify row_number() over (partition by lower(p_name) order by p_partkey) = 1"),
    "email_check": (email_check, "select p_partkey, p_partkey % 4 = 0 as ok from part"),
    "decoded_text": (decoded_text, f"select page_id, replace(replace(replace(replace(replace(replace({_FLAT}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') as text from pages"),
}
