"""Search filters from a query's words, without a service: prices by pattern, then the longest known phrases.

The known phrases are a table: brands of the catalog, categories, colours, sizes and words for whom; a phrase is folded (lower
case, letters and digits alone). A query's word runs of up to the longest phrase meet the table by a join; of what is
found the leftmost, of these the longest stands, and nothing overlaps. What no filter takes, without stop words, is the
semantic query. A struct from elsewhere is held against the same schema (``problems``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import categories, literals
from quarrymill.functions.scalars import COLOR_HEX, SIZE_ALIASES
from quarrymill.functions.stemming import STOP_WORDS
from quarrymill.session import spread

# The struct's fields and kinds, and what a gender may be.
FIELDS = {
    "gender": "string?", "categories": "array", "minPrice": "number?", "maxPrice": "number?", "brand": "string?", "sizes": "array", "colors": "array", "onSale": "boolean",
    "semantic_query": "string", "response_text": "string", "suggested_refinements": "array",
}
GENDER_ENUM = ("Women", "Men", "Boys", "Girls", "Unisex")
# End of the fixed values.

GENDER_PHRASES = {"Women": "women woman womens ladies lady female", "Men": "men man mens gents male", "Boys": "boy boys", "Girls": "girl girls", "Unisex": "unisex"}
SALE_PHRASES = ("on sale", "sale", "discount", "discounted", "clearance", "reduced")
#: Other names of categories, besides their own and their plurals.
ALSO = {"Trouser": "pants pant", "T-Shirt": "tee tees tshirt tshirts", "Shoes": "shoe", "Jumpsuit": "playsuit", "Sunglasses": "glasses", "Jewelry": "jewellery", "Perfume": "fragrance", "Jacket": "blazer coat", "Scarf": "scarves stole"}
PRIORITY = ("brand", "category", "gender", "color", "size", "sale")
FILLERS = frozenset("show find want need looking please get give me anything something some price rs pkr clothes clothing size sizes color colors colour".split())
_NUMBER = r"(?:rs\.?|pkr)?\s*(\d[\d,]*(?:\.\d+)?)(k?)\b"
#: Between two numbers; a greatest one; a least one.
_BETWEEN = rf"\bbetween\s+{_NUMBER}\s*(?:and|to|-)\s*{_NUMBER}"
_MOST = rf"\b(?:under|below|less than|up to|upto|within|at most|cheaper than|max(?:imum)?)\s+{_NUMBER}"
_LEAST = rf"\b(?:over|above|more than|at least|starting (?:from|at)|min(?:imum)?)\s+{_NUMBER}"


def folded(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, ends trimmed; apostrophes go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), r"(?U)[\W_]+", " "))


def phrases(spark: SparkSession, brands: DataFrame) -> DataFrame:
    """phrase, kind, value, words: all known phrases; ``brands`` has name. Of a phrase with several meanings the first kind of ``PRIORITY`` stands, then the first value."""
    known: list[tuple[str, str, str]] = []
    names = {leaf for _, _, leaf, _ in categories.leaf_rows()} | {x for b, s, _, _ in categories.leaf_rows() for x in (b, s) if x}
    for name in sorted(names):
        forms = [name, name + "s", name + "es", *ALSO.get(name, "").split()] + ([name[:-1] + "ies"] if name.endswith("y") else [])
        known += [(x, "category", name) for x in forms]
    known += [(x, "gender", g) for g, words in GENDER_PHRASES.items() for x in words.split()]
    known += [(x, "color", x.lower()) for x in (*COLOR_HEX, *(n for n, _ in literals.COLORS))]
    # a letter alone is no size: "s" and "m" are words of many queries
    known += [(f"size {x}", "size", label) for label, xs in SIZE_ALIASES.items() for x in xs] + [(x, "size", label) for label, xs in SIZE_ALIASES.items() for x in xs if len(x) > 1]
    known += [(x, "sale", "sale") for x in SALE_PHRASES]
    table = literals.values(spark, known, ["phrase", "kind", "value"]).select("phrase", "kind", "value").unionByName(brands.select(F.col("name").alias("phrase"), F.lit("brand").alias("kind"), F.col("name").alias("value")))
    rank = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), F.col("kind"))
    table = table.withColumn("phrase", folded(F.col("phrase"))).where("phrase <> ''")
    one = table.groupBy("phrase").agg(F.min_by(F.struct("kind", "value"), F.struct(rank, F.col("value"))).alias("x"))
    return one.select("phrase", "x.kind", "x.value", F.size(F.split("phrase", " ")).alias("words"))


def _price(text: Column, pattern: str, at: int) -> Column:
    raw = F.regexp_extract(text, pattern, at)
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double") * F.when(F.regexp_extract(text, pattern, at + 1) == "k", 1000.0).otherwise(1.0)


def filters(queries: DataFrame, key: str, text: str, known: DataFrame, longest: int = 4) -> DataFrame:
    """``key`` and the struct's fields but for the two that a service writes: gender, categories, minPrice, maxPrice, brand, sizes, colors, onSale, semantic_query.

    A null or empty query has no filter and an empty semantic query. Lists are in the order of the query, each value once; of
    several genders or brands the first counts. Phrases of more than ``longest`` words aren't looked for. Keys are unique.
    The queries are dealt out by key first, as a small file of them is much work; all else but the known phrases stays in place.
    """
    rows = spread(queries.select(key, F.col(text).alias("__q")), key).select(key, F.lower(F.coalesce(F.col("__q").cast("string"), F.lit(""))).alias("__t"))
    between = F.regexp_extract("__t", _BETWEEN, 1) != ""
    least = F.when(between, _price(F.col("__t"), _BETWEEN, 1)).otherwise(_price(F.col("__t"), _LEAST, 1))
    most = F.when(between, _price(F.col("__t"), _BETWEEN, 3)).otherwise(_price(F.col("__t"), _MOST, 1))
    bare = reduce(lambda t, p: F.regexp_replace(t, p, " "), (_BETWEEN, _MOST, _LEAST), F.col("__t"))
    rows = rows.select(key, least.alias("minPrice"), most.alias("maxPrice"), F.filter(F.split(folded(bare), " "), lambda w: w != "").alias("__w"))
    n = F.size("__w")
    # two plain generators: a place and how many words from there; where there is no word neither gives a row
    upto = lambda m: F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    runs = rows.select(key, "__w", F.explode(upto(n)).alias("at"))
    runs = runs.select(key, "__w", "at", F.explode(upto(F.least(F.lit(longest), n - F.col("at") + 1))).alias("k"))
    runs = runs.select(key, "at", "k", F.array_join(F.slice("__w", F.col("at"), F.col("k")), " ").alias("phrase"))
    # the known phrases are few: Spark broadcasts them by their size
    met = runs.join(known.select("phrase", "kind", "value"), "phrase").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("k")).alias("minus_k"), "kind", "value"))).alias("__found"))
    kind = "array<struct<at:int,minus_k:int,kind:string,value:string>>"
    end = lambda taken: F.when(F.size(taken) == 0, 0).otherwise(F.try_element_at(taken, F.lit(-1))["at"] - F.try_element_at(taken, F.lit(-1))["minus_k"])
    taken = F.aggregate("__found", F.array().cast(kind), lambda s, x: F.when(x["at"] >= end(s), F.concat(s, F.array(x))).otherwise(s))
    rows = rows.join(met, key, "left").withColumn("__taken", F.coalesce(taken, F.array().cast(kind)))
    of = lambda k: F.array_distinct(F.transform(F.filter("__taken", lambda x: x["kind"] == k), lambda x: x["value"]))
    dropped = F.array(*[F.lit(w) for w in sorted(STOP_WORDS | FILLERS)])
    rest = F.filter("__w", lambda w, i: ~F.exists("__taken", lambda x: (i + 1 >= x["at"]) & (i + 1 < x["at"] - x["minus_k"])) & ~F.array_contains(dropped, w))
    return rows.select(
        key, F.try_element_at(of("gender"), F.lit(1)).alias("gender"), of("category").alias("categories"), "minPrice", "maxPrice", F.try_element_at(of("brand"), F.lit(1)).alias("brand"),
        of("size").alias("sizes"), of("color").alias("colors"), (F.size(of("sale")) > 0).alias("onSale"), F.array_join(rest, " ").alias("semantic_query"),
    )


def problems(answer: Column) -> Column:
    """What is wrong with a filter struct given as JSON text, as an array of short texts; empty for a valid one.

    Strict: it is one object, every field is there, no other is, each has its kind, gender and categories are known ones.
    """
    keys = F.json_object_keys(answer)
    names = F.array(*[F.lit(x) for x in FIELDS])
    value = lambda f: F.get_json_object(answer, f"$.{f}")
    out = [F.when(~F.coalesce(answer.rlike(r"(?s)^\s*\{.*\}\s*$") & keys.isNotNull(), F.lit(False)), "no object")]
    out.append(F.when(F.size(F.array_except(keys, names)) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(F.array_except(keys, names)), ", "))))
    out.append(F.when(F.size(F.array_except(names, keys)) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_except(names, keys), ", "))))
    # a value's own JSON tells its kind: one element of an array of it is written with its quotes
    for name, kind in FIELDS.items():
        raw = F.regexp_extract(F.get_json_object(answer, "$"), rf'(?s)"{name}"\s*:\s*(\S)', 1)
        ok = {"array": raw == "[", "boolean": raw.isin("t", "f"), "string": raw == '"', "string?": raw.isin('"', "n"), "number?": raw.rlike(r"^[-0-9n]$")}[kind]
        out.append(F.when(F.array_contains(keys, name) & ~ok, F.lit(f"{name} is no {kind.rstrip('?')}")))
    known = sorted({leaf for _, _, leaf, _ in categories.leaf_rows()} | {x for b, s, _, _ in categories.leaf_rows() for x in (b, s) if x})
    out.append(F.when(value("gender").isNotNull() & ~value("gender").isin(*GENDER_ENUM), "gender is unknown"))
    named = F.coalesce(F.from_json(value("categories"), "array<string>"), F.array().cast("array<string>"))
    out.append(F.when(F.size(F.array_except(named, F.array(*[F.lit(x) for x in known]))) > 0, "a category is unknown"))
    return F.array_compact(F.array(*out))
