"""Filters from shoppers' queries; the queries are put together from parts, and the oracle knows the parts, not the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import understanding
from quarrymill.plans.tables import table
from quarrymill.session import written

COLORS = [("navy", "navy"), ("sky blue", "sky blue"), ("Off-White", "off-white"), ("red", "red"), ("", "")]
GARMENTS = [("polos", "Polo", ""), ("t-shirts and jeans", "T-Shirt|Jeans", ""), ("cargo trousers", "Cargo Trouser", ""), ("SHALWAR  kameez", "Shalwar Kameez", ""), ("tees", "T-Shirt", ""), ("knitted", "", "knitted "), ("upperwear", "Upperwear", "")]
GENDERS = [("for women", "'Women'"), ("men's", "'Men'"), ("", "null"), ("for boys", "'Boys'")]
PRICES = [("under 5,000", "null", "5000"), ("between 1k and Rs. 2500", "1000", "2500"), ("over 900", "900", "null"), ("", "null", "null"), ("less than pkr 3000.50", "null", "3000.5")]
SIZES = [("size m", "M"), ("XL", "XL"), ("", "")]
SALES = [("on sale", "true"), ("", "false")]


def query_filters(s, d):
    """A query a part, with its brand's name and the noun of its own."""
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x[0]) for x in xs]), (F.expr(at) % len(xs) + 1).cast("int"))
    noun = F.element_at(F.split("p_name", " "), -1)
    text = F.concat_ws(" ", F.lit("Show me"), pick(COLORS, "p_partkey"), pick(GARMENTS, "p_partkey"), pick(GENDERS, "p_partkey div 3"), pick(PRICES, "p_partkey div 2"), F.lit("by"), "p_brand", pick(SIZES, "p_partkey div 7"), pick(SALES, "p_partkey div 11"), noun)
    part = table(s, d, "part")
    # a table of its own, so that Spark knows its size when it plans the join: an estimate from the parts' file would shuffle every run of words
    known = written(understanding.phrases(s, part.select(F.col("p_brand").alias("name")).distinct()), "phrases")
    found = understanding.filters(part.select("p_partkey", text.alias("q")), "p_partkey", "q", known)
    return found.select("p_partkey", "gender", F.array_join("categories", "|").alias("categories"), "minPrice", "maxPrice", "brand", F.array_join("sizes", "|").alias("sizes"), F.array_join("colors", "|").alias("colors"), "onSale", "semantic_query")


def _pick(values: list[str], at: str, quoted: bool = True) -> str:
    return "([" + ", ".join(f"'{v}'" if quoted else v for v in values) + f"])[({at}) % {len(values)} + 1]"


QUERIES = {
    "query_filters": (query_filters, f"""select p_partkey, {_pick([x[1] for x in GENDERS], 'p_partkey // 3', False)} as gender, {_pick([x[1] for x in GARMENTS], 'p_partkey')} as categories,
      {_pick([x[1] for x in PRICES], 'p_partkey // 2', False)}::double as "minPrice", {_pick([x[2] for x in PRICES], 'p_partkey // 2', False)}::double as "maxPrice", p_brand as brand, {_pick([x[1] for x in SIZES], 'p_partkey // 7')} as sizes,
      {_pick([x[1] for x in COLORS], 'p_partkey')} as colors, {_pick([x[1] for x in SALES], 'p_partkey // 11', False)} as "onSale", {_pick([x[2] for x in GARMENTS], 'p_partkey')} || string_split(p_name, ' ')[2] as semantic_query from part"""),
}
