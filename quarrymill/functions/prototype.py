"""The prototype's catalog functions: options as colours and sizes, and a classifier of its own, as a rule set.

``option_axes`` takes a product's (option name, value) pairs. Options named colour or size are what they say; the option
"Title", which some stores misuse, is voted on by its own values: it is a size if half of them look so, else a colour if
half of them do, else nothing. Labels are normalized, repeats go, the order of appearance stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.rules import decide

# What decides which label a product or an option value gets.
PLACEHOLDERS = ("default title", "default", "")
SIZE_WORDS = ("xxs", "xs", "s", "m", "l", "xl", "xxl", "2xl", "3xl", "4xl", "5xl", "xxxl")
NAMED_SIZES = ("free size", "one size")
COLOR_WORDS = "black white navy blue red maroon green olive khaki beige grey gray brown pink purple yellow orange teal mustard charcoal cream ivory rust burgundy mint lavender coral peach tan gold silver".split()
GENDERS = [
    ("Boys", r"\bboys?|junior boy|infant boy|baby boy|teen boy\b"),
    ("Girls", r"\bgirls?|junior girl|infant girl|baby girl|teen girl\b"),
    ("Unisex", r"\bunisex|kids unisex\b"),
    ("Women", r"\bwom[ae]n|ladies|lady|her\b\b"),
    ("Men", r"\bmen'?s?|gents?|him\b|\bd man\b\b"),
]
MEN_STORES = ("equator", "monark", "charcoal", "royal_tag", "cambridge", "uniworth", "furor")
PATTERNS = {
    "fragrance": r"perfume|fragrance|cologne|deodorant|\bedt\b|\bedp\b|attar|body spray|mist\b",
    "accessory": r"\bbelt|\btie\b|\bcap\b|caps\b|cufflink|sunglass|\bglasses\b|jewel|earring|\bbracelet|\bbag\b|bags\b|wallet|\bscarf|scarves|stole|dupatta|shawl|\bsock|watch\b|\bhat\b|beanie|necktie|brace(s)?\b",
    "unstitched": r"un[\s-]?stitched|unstitch",
    "semi": r"semi[\s-]?stitched|semi[\s-]?stitch",
    "eastern": r"kurta|shalwar|kameez|kurti|sherwani|eastern|lawn|khaddar|cambric|viscose suit|3[\s-]?piece|2[\s-]?piece|1[\s-]?piece|suit length|unstitched|semi[\s-]?stitched",
    "footwear": r"shoe|sandal|slide|sneaker|loafer|footwear",
    "bottom": r"trouser|jean|denim pant|\bpant(s)?\b|short(s)?\b|jogger|chino|track pant",
    "suits": r"blazer|waist ?coat|\bsuit(s)?\b(?!.*length)|co-?ord|frock|jumpsuit|\bdress(es)?\b|combo suit|sherwani suit|3 piece stitched|2 piece stitched",
    "western": r"shirt|tee\b|t-shirt|polo|jacket|hoodie|sweatshirt|sweater|blouse|\btop\b|tank|coat|western|denim|graphic tee|activewear",
}
#: Everything, some, nothing of the patterns, and (branch, sub, group of leaves); the first that holds decides.
BRANCHES = [
    (["fragrance"], [], [], ("Fragrance & Beauty", None, "fragrance")),
    (["accessory"], [], ["western"], ("Accessories", None, "accessory")),
    (["eastern", "unstitched"], [], ["footwear"], ("Eastern", "Unstitched", "eastern")),
    (["eastern", "semi"], [], ["footwear"], ("Eastern", "Semi-Stitched", "eastern")),
    (["eastern"], [], ["footwear"], ("Eastern", "Stitched", "eastern")),
    (["footwear"], [], [], ("Western", "Footwear", "footwear")),
    (["suits"], [], [], ("Western", "Suits & Sets", "suits")),
    (["bottom"], [], [], ("Western", "Bottomwear", "bottom")),
    (["western"], [], [], ("Western", "Upperwear", "upper")),
    (["accessory"], [], [], ("Accessories", None, "accessory")),
    ([], [], [], ("Western", "Upperwear", "none")),
]
#: Leaves by group, in order; the last one is for texts that none fits.
LEAVES = {
    "fragrance": [("Deodorant", r"deodorant|body spray"), ("Perfume", None)],
    "accessory": [
        ("Belts", r"belt"), ("Ties", r"\btie\b|necktie"), ("Caps & Hats", r"\bcap\b|caps\b|\bhat\b|beanie"), ("Cufflinks", r"cufflink"), ("Sunglasses", r"sunglass|\bglasses\b"),
        ("Jewellery", r"jewel|earring|\bbracelet"), ("Bags", r"\bbag\b|bags\b|wallet"), ("Scarves & Stoles", r"scarf|scarves|stole|shawl|dupatta"), ("Socks", r"\bsock"), ("Watches", r"watch"), ("Accessories", None),
    ],
    "eastern": [
        ("Shalwar Kameez", r"shalwar kameez|shalwar\s*kameez|kameez shalwar"), ("Kurta Set", r"kurta shalwar|kurta pajama|kurta set"), ("Sherwani", r"sherwani"), ("Kurti", r"kurti"),
        ("3-Piece", r"3[\s-]?piece"), ("2-Piece", r"2[\s-]?piece"), ("1-Piece", r"1[\s-]?piece"), ("Dupatta & Shawl", r"dupatta|shawl|stole"), ("Waistcoat Suit", r"waist ?coat"),
        ("Kurta", r"kurta"), ("Unstitched Fabric", r"unstitched|fabric"), ("Kurta", None),
    ],
    "footwear": [("Sandals", r"sandal|slide"), ("Sneakers", r"sneaker"), ("Shoes", None)],
    "suits": [("Blazer", r"blazer"), ("Waistcoat Suit", r"waist ?coat"), ("Co-ord Set", r"co-?ord"), ("Dress", r"dress|frock|jumpsuit"), ("Formal Suit", None)],
    "bottom": [("Jeans", r"jean|denim"), ("Jogger", r"jogger|track pant"), ("Chino", r"chino"), ("Shorts", r"short"), ("Trouser", None)],
    "upper": [
        ("Polo Shirt", r"polo"), ("Graphic Tee", r"graphic tee"), ("T-Shirt", r"\btee\b|t-shirt|tank top"), ("Formal Shirt", r"formal shirt|dress shirt"), ("Casual Shirt", r"casual shirt"),
        ("Shirt", r"shirt|blouse"), ("Hoodie", r"hoodie"), ("Sweatshirt", r"sweatshirt"), ("Sweater", r"sweater|knitwear"), ("Jacket", r"jacket|outerwear|long coat"), ("Top", r"\btop\b|fashion top"), ("Shirt", None),
    ],
    "none": [("Apparel", None)],
}
# End of the fixed values.


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?U)" + pattern), F.lit(False))


def _by_order(text: Column, labels: list[tuple[str, str | None]]) -> Column:
    """The first label whose pattern is found, by the evaluator: each is a rule of one test, one without a pattern always holds."""
    return decide([([p] if p else [], [], [], name) for name, p in labels], lambda p: _found(text, p), F.lit)


def classify_prototype(product_type: Column, title: Column, tags: Column, vendor: Column, store: Column) -> Column:
    """A struct (gender, branch, sub, category); null texts count as empty."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (product_type, title, tags, vendor)]))
    gender = F.coalesce(_by_order(text, GENDERS), F.when(store.isin(*MEN_STORES), "Men"), F.lit("Unisex"))

    def leaf(outcome: object) -> Column:
        branch, sub, group = outcome
        return F.struct(F.lit(branch).alias("branch"), F.lit(sub).cast("string").alias("sub"), _by_order(text, LEAVES[group]).alias("category"))

    found = decide(BRANCHES, lambda name: _found(text, PATTERNS[name]), leaf)
    return F.struct(gender.alias("gender"), found["branch"].alias("branch"), found["sub"].alias("sub"), found["category"].alias("category"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def placeholder(value: Column) -> Column:
    return F.lower(_bare(F.coalesce(value, F.lit("")))).isin(*PLACEHOLDERS)


def looks_like_size(value: Column) -> Column:
    """A size word, digits alone (with blanks, dashes, dots), or digits with up to three letters: 40.5, 7-8, 12Y."""
    few = lambda v: _let(F.regexp_replace(v, r"(?U)[0-9\s.\-–]", ""), lambda x: (x == "") | (x.rlike("^[A-Za-z]{1,3}$") & v.rlike(r"(?U)\d")))
    return _let(_bare(value), lambda v: F.lower(v).isin(*SIZE_WORDS, *NAMED_SIZES) | few(v))


def looks_like_color(value: Column) -> Column:
    return F.lower(value).rlike(rf"(?U)\b({'|'.join(COLOR_WORDS)})\b")


def _titled(text: Column) -> Column:
    """Letters behind a letter in lower case, the others in upper case."""
    one = lambda i: F.substring(text, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.when((i > 1) & one(F.greatest(i - 1, F.lit(1))).rlike(r"\p{L}"), F.lower(one(i))).otherwise(F.upper(one(i)))), "")


def label_of(value: Column) -> Column:
    """Size words in capitals, a number's unit in lower case and close to it, longer words of capitals alone as titles."""
    unit = r"^(\d+(?:\.\d+)?)\s*([a-zA-Z]{1,3})$"
    shouted = lambda v: (F.upper(v) == v) & (F.lower(v) != v) & (F.length(v) > 2)
    return _let(_bare(value), lambda v: F.when(F.lower(v).isin(*SIZE_WORDS), F.upper(v)).when(v.rlike(unit), F.concat(F.regexp_extract(v, unit, 1), F.lower(F.regexp_extract(v, unit, 2)))).when(shouted(v), _titled(v)).otherwise(v))


def _once(labels: Column) -> Column:
    """The labels without later ones that differ in case alone."""
    folded = lambda xs: F.struct(xs.alias("xs"), F.transform(xs, F.lower).alias("low"))
    first = lambda p: F.filter(p["xs"], lambda x, i: F.array_position(p["low"], F.lower(x)) == i + 1)
    # equal labels go first, by hash, so only labels that differ are compared
    return _let(F.array_distinct(labels), lambda xs: _let(folded(xs), first))


def _axis(name: Column) -> Column:
    """c for colours, s for sizes, t for the option Title, null for others."""
    return _let(F.lower(_bare(F.coalesce(name, F.lit("")))), lambda n: F.when(n.contains("color"), "c").when(n.contains("size"), "s").when(n == "title", "t"))


def option_axes(pairs: Column) -> Column:
    """A struct (colors, sizes) of an array of (name, value); null and placeholder values don't count, other options are left out. A null array has neither.

    Each pair is looked at once, each different value of an axis is labelled once.
    """
    none = F.array().cast("array<string>")
    told = F.transform(F.coalesce(pairs, F.array()), lambda x: F.struct(_axis(x["name"]).alias("axis"), x["value"].alias("value")))
    real = F.filter(told, lambda x: x["axis"].isNotNull() & ~placeholder(x["value"]))
    of = lambda xs, axis: F.transform(F.filter(xs, lambda x: x["axis"] == axis), lambda x: x["value"])
    half = lambda titles, test: (F.size(titles) > 0) & (F.size(F.filter(titles, test)) * 2 >= F.size(titles))
    vote = lambda titles: F.when(half(titles, looks_like_size), "s").when(half(titles, looks_like_color), "c")
    labels = lambda values: _once(F.transform(F.array_distinct(values), label_of))

    def both(x: Column) -> Column:
        more = lambda axis: F.when(x["vote"] == axis, x["titles"]).otherwise(none)
        return F.struct(labels(F.concat(of(x["real"], "c"), more("c"))).alias("colors"), labels(F.concat(of(x["real"], "s"), more("s"))).alias("sizes"))

    split = lambda xs: F.struct(xs.alias("real"), of(xs, "t").alias("titles"))
    voted = lambda x: F.struct(x["real"].alias("real"), x["titles"].alias("titles"), vote(x["titles"]).alias("vote"))
    return _let(real, lambda xs: _let(split(xs), lambda x: _let(voted(x), both)))
