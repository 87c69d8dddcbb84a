"""Scalar functions and rule cascades over part names, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import facets
from quarrymill.plans.tables import table


def strip_html(s, d):
    return table(s, d, "pages").select("page_id", scalars.strip_html(F.col("html")).alias("text"))


_SIZES = "case p_partkey % 9 when 0 then '2-3Y' when 1 then '50 ml' when 2 then '32' when 3 then '-' when 4 then 'OS' when 5 then 'XL' when 6 then '' when 7 then '10Y' else null end"


def size_system_case(s, d):
    return table(s, d, "part").withColumn("size", F.expr(_SIZES)).select("p_partkey", scalars.size_system(F.col("size")).alias("system"))


def canonical_sizes(s, d):
    from quarrymill.plans.browse import _LABEL

    return table(s, d, "lineitem").withColumn("size", F.expr(_LABEL)).groupBy(scalars.canonical_size(F.col("size")).alias("size")).agg(F.count("*").alias("n"))


#: Rules without look-around, which both engines read alike.
RULES = [(r"(?i)\b(ring|washer)s?\b", "Round"), (r"(?i)\b(bolt|screw|nail)s?\b", "Fastener"), (r"(?i)\bred\b|\bblue\b", "Coloured"), (r"(?i)^small", "Small")]


def first_match_rules(s, d):
    return table(s, d, "part").select("p_partkey", scalars.first_match(F.col("p_name"), RULES, "Other").alias("label"))


_PERSON = "case p_partkey % 6 when 0 then 'Women Kurta' when 1 then 'for men and women' when 2 then 'BOYS shirt' when 3 then 'Woman of kids' when 4 then 'kids wear' else 'plain' end"


def gender_cascade(s, d):
    from quarrymill.functions.classify import gender_of

    rows = table(s, d, "part").select("p_partkey", F.expr(_PERSON).alias("title"), F.expr("if(p_partkey % 10 = 0, 'Girls Corner', p_brand)").alias("vendor"))
    none = F.lit("")
    return rows.select("p_partkey", gender_of(vendor=F.col("vendor"), title=F.col("title"), product_type=none, tags=none, store=none, kids_sizing=F.lit(False)).alias("gender"))


def piece_extract(s, d):
    text = F.concat(F.lit("Shirt: "), (F.col("p_size") % 5).cast("string"), F.lit(" meter Lawn, TROUSER: 2.5 m; dupatta: x "), F.col("p_name"))
    rows = table(s, d, "part").select("p_partkey", F.posexplode(scalars.pieces(text)).alias("i", "x"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("sort_order"), "x.piece_name", F.col("x.length_meters").cast("double").alias("length_meters"), "x.fabric")


def classify_full(s, d):
    """The whole classifier over titles made of part names and words of documents."""
    from quarrymill.functions.classify import products

    words = table(s, d, "documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("description"))
    garment = F.element_at(F.array(*[F.lit(x) for x in ("Kurta Set", "Denim Jacket", "Cargo Trouser", "Polo", "Leather Belt", "3 Piece Suit", "Running Shoes", "Hoodie")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = table(s, d, "part").join(words, "p_partkey", "left").select("p_partkey", F.concat_ws(" ", "p_name", garment).alias("title"), F.col("p_type").alias("product_type"), F.lit("").alias("tags"), F.col("p_brand").alias("vendor"), F.lit("").alias("store"), "description", F.lit(False).alias("kids_sizing"))
    return products(rows).select("p_partkey", "class.*")


def compare_at_clean(s, d):
    price, other = F.col("price"), F.expr("case p_partkey % 4 when 0 then '0.00' when 1 then price when 2 then '950.0' else null end")
    rows = table(s, d, "part").select("p_partkey", F.format_string("%.2f", "p_retailprice").alias("price")).withColumn("other", other)
    return rows.select("p_partkey", scalars.to_money(scalars.clean_compare_at(F.col("other"), price)).cast("double").alias("compare_at"))


def slugs_and_links(s, d):
    return table(s, d, "part").select("p_partkey", scalars.slug(F.col("p_name")).alias("slug"), scalars.product_url(F.lit("https://x.example"), F.when(F.col("p_size") > 10, scalars.slug(F.col("p_name")))).alias("url"), scalars.embedding_text(F.col("p_name"), F.nullif(F.col("p_type"), F.lit("SMALL")), F.col("p_brand")).alias("embedding_text"))


def tag_flags(s, d):
    tags = scalars.parse_tags(F.expr("concat(p_name, ', ', if(p_size < 10, ' Cart-Hide ', 'x'), ',,', p_type)"))
    return table(s, d, "part").select("p_partkey", F.array_join(tags, "|").alias("tags"), scalars.forced_unavailable(tags).alias("out"))


def profile_top_values(s, d):
    return facets.top_values(table(s, d, "part"), "p_brand", "p_type", 3).select("p_brand", "p_type", "n", "rn")


def profile_titles(s, d):
    words = scalars.word_count(F.col("p_name"))
    return table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min(words).alias("least"), F.max(words).alias("most"), F.round(F.avg(words.cast("double")), 6).alias("mean"), F.count_if(F.col("p_name").rlike("^[a-m]")).alias("coded"), F.countDistinct("p_type").alias("types"))


def size_dominance(s, d):
    rows = table(s, d, "part").withColumn("system", scalars.size_system(F.expr(_SIZES)))
    return facets.dominance(rows, ["p_type"], "system").select("p_type", "dominant", "n", "total", F.round("minority", 6).alias("minority"))


QUERIES = {
    "strip_html": (strip_html, r"select page_id, nullif(substring(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{00A0}\x0B\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), 1, 2000), '') as text from pages"),
    "size_system_case": (size_system_case, f"select p_partkey, case when s is null or s = '' then 'none' when regexp_matches(s, '(?i)^([0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]+)Y$') then 'kids_age_years' when regexp_matches(s, '(?i)^[0-9]{{2,3}}\\s*ml$') then 'volume_ml' when regexp_matches(s, '^[0-9]{{2}}$') then 'waist_inches' when trim(s) in ('-', 'One Size', 'OS') then 'one_size' else 'alpha' end as system from (select p_partkey, {_SIZES} as s from part)"),
    "canonical_sizes": (canonical_sizes, "select case l_quantity::int % 8 when 0 then 'XS' when 1 then 'S' when 2 then 'S' when 3 then 'M' when 4 then 'M' when 5 then 'L' when 6 then 'XXL' else 'L-XL' end as size, count(*) as n from lineitem group by 1"),
    "first_match_rules": (first_match_rules, "select p_partkey, case " + " ".join(f"when regexp_matches(p_name, '{p}') then '{v}'" for p, v in RULES) + " else 'Other' end as label from part"),
    "gender_cascade": (gender_cascade, f"select p_partkey, case when p_partkey % 10 = 0 then 'Girls' when p_partkey % 6 in (0, 1, 3) then 'Women' when p_partkey % 6 = 2 then 'Boys' else 'Unisex' end as gender from part"),
    "piece_extract": (piece_extract, "select p_partkey, 0::bigint as sort_order, 'Shirt' as piece_name, (p_size % 5)::double as length_meters, 'Lawn' as fabric from part union all select p_partkey, 1, 'Trouser', 2.5, null from part"),
    "classify_full": (classify_full, None),
    "compare_at_clean": (compare_at_clean, "select p_partkey, case when p_partkey % 4 = 2 and printf('%.2f', p_retailprice) <> '950.0' then 950.0 end::double as compare_at from part"),
    "slugs_and_links": (slugs_and_links, "select p_partkey, regexp_replace(lower(p_name), '[^a-z]+', '-', 'g') as slug, case when p_size > 10 then 'https://x.example/products/' || regexp_replace(lower(p_name), '[^a-z]+', '-', 'g') else 'https://x.example' end as url, concat_ws('. ', p_name, nullif(p_type, 'SMALL'), p_brand) as embedding_text from part"),
    "tag_flags": (tag_flags, "select p_partkey, p_name || '|' || case when p_size < 10 then 'Cart-Hide' else 'x' end || '|' || p_type as tags, p_size < 10 as out from part"),
    "profile_top_values": (profile_top_values, "select p_brand, p_type, n, rn from (select p_brand, p_type, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as rn from part group by 1, 2) where rn <= 3"),
    "profile_titles": (profile_titles, "with w as (select *, len(string_split(trim(p_name), ' '))::bigint as k from part) select p_brand, count(*) as n, min(k) as least, max(k) as most, round(avg(k::double), 6) as mean, count(*) filter (regexp_matches(p_name, '^[a-m]')) as coded, count(distinct p_type) as types from w group by 1"),
    "size_dominance": (size_dominance, f"with s as (select p_type, case p_partkey % 9 when 0 then 'kids_age_years' when 7 then 'kids_age_years' when 1 then 'volume_ml' when 2 then 'waist_inches' when 3 then 'one_size' when 4 then 'one_size' when 5 then 'alpha' else 'none' end as system from part), c as (select p_type, system, count(*) as n from s group by 1, 2), t as (select p_type, arg_max(system, {{n: n, s: system}}) as dominant, max(n) as n, sum(n)::bigint as total from c group by 1) select p_type, dominant, n, total, round(1 - n / total, 6) as minority from t"),
}
