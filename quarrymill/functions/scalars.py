"""Scalar functions over catalog text, prices and options, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of sizes by canonical label; fixed values.
SIZE_ALIASES = {
    "XS": ["xs", "extra small", "x-small", "xsmall"],
    "S": ["s", "small"],
    "M": ["m", "medium"],
    "L": ["l", "large"],
    "XL": ["xl", "extra large", "x-large", "xlarge"],
    "XXL": ["xxl", "2xl", "xx-large", "xxlarge"],
    "XXXL": ["xxxl", "3xl", "xxx-large", "xxxlarge"],
}
#: Tags that make a product unavailable whatever its stock says; fixed values.
FORCED_OUT = ("cart-hide", "hide-atc", "hide-variant-fragrance")

#: Systems of size labels, the first pattern that fits decides; fixed values.
SIZE_SYSTEMS = [
    (r"(?i)^\d{1,2}-\d{1,2}Y$", "kids_age_years"),
    (r"(?i)^\d+Y$", "kids_age_years"),
    (r"(?i)^\d{2,3}\s*ml$", "volume_ml"),
    (r"^\d{2}$", "waist_inches"),
]
ONE_SIZE = ("-", "One Size", "OS")

#: Hex values of colour names, and that of any other; fixed values.
COLOR_HEX = {
    "black": "#1a1a1a", "white": "#f7f5f0", "navy": "#1c2a4a", "blue": "#3b6ea5", "sky blue": "#8ec6e6", "red": "#b23a2e", "maroon": "#6e1f2a", "green": "#3f6b45", "olive": "#6b6b3a",
    "khaki": "#c3b091", "beige": "#e3d5b8", "grey": "#8a8681", "gray": "#8a8681", "brown": "#5b3d2b", "pink": "#e2a0b0", "purple": "#6a4c7a", "yellow": "#e0c14c", "orange": "#d97f34",
    "teal": "#2f7a72", "mustard": "#c9a13a", "charcoal": "#3a3733", "cream": "#f0e6cf", "ivory": "#f5f0e0", "rust": "#a4502e", "burgundy": "#5e1f2e", "mint": "#a9d6c4",
    "lavender": "#c9bfe0", "coral": "#e08770", "peach": "#f0c3a0", "tan": "#d2b48c", "gold": "#c9a227", "silver": "#c0c0c0", "stone": "#a89f8f",
}
OTHER_HEX = "#a89f8f"


def color_hex(name: Column) -> Column:
    """The hex value of a colour name, whatever its case; a default for others and null."""
    pairs = [F.lit(v) for item in COLOR_HEX.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(name)), F.lit(OTHER_HEX))


def strip_html(html: Column, most: int = 2000) -> Column:
    """Tags become spaces, white space (also Unicode's) collapses, ends are trimmed, the text is cut; empty gives null. Entities stay."""
    flat = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " ")
    return F.nullif(F.substring(F.trim(flat), 1, most), F.lit(""))


#: Named references and their signs, fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    """The named references above and all numeric ones, in one pass: what a reference gives is not decoded again. Others stay."""
    point = lambda r: F.coalesce(F.conv(F.nullif(F.regexp_extract(r, "^&#[xX]([0-9a-fA-F]{1,6});$", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(r, r"^&#(\d{1,7});$", 1), F.lit(""))).try_cast("int")
    sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    fine = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    pairs = [F.lit(x) for item in ENTITIES.items() for x in item]
    named = lambda r: F.element_at(F.create_map(*pairs), r)
    one = lambda r: F.when(~r.startswith("&"), r).otherwise(F.coalesce(named(r), F.when(fine(point(r)), sign(point(r))), r))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#?[a-zA-Z0-9]{1,10};|&|[^&]+"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def price_text(value: Column, currency: str = "PKR") -> Column:
    """A whole price with its thousands apart, as in 'Rs. 12,500'; halves go up, null and NaN give an empty text."""
    whole = F.format_number(F.floor(value.cast("double") + 0.5).cast("long"), 0)
    return F.when(value.isNull() | F.isnan(value.cast("double")), "").otherwise(F.concat(F.lit("Rs. " if currency == "PKR" else f"{currency} "), whole))


def gallery(images_json: Column, image_url: Column) -> Column:
    """A product page's images: those of a JSON list, else the one image, else none; a list that can't be read counts as none."""
    found = F.coalesce(F.try_variant_get(F.try_parse_json(images_json), "$", "array<string>"), F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).when(F.coalesce(image_url, F.lit("")) != "", F.array(image_url)).otherwise(F.array().cast("array<string>"))


def canonical_size(size: Column) -> Column:
    """The canonical label of a known spelling, else the trimmed original."""
    pairs = [v for label, names in SIZE_ALIASES.items() for n in names for v in (F.lit(n), F.lit(label))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(size))), F.trim(size))


def size_spellings(labels: list[str]) -> list[str]:
    """All spellings, in lower case, that the wanted canonical sizes stand for, themselves included."""
    out = [x for label in labels for x in (label.strip().lower(), *SIZE_ALIASES.get(label.strip().upper(), []))]
    return list(dict.fromkeys(out))


def size_system(size: Column) -> Column:
    """none for null and empty, else the system of the first pattern that fits, one_size for its names, else alpha."""
    named = F.when(F.trim(size).isin(*ONE_SIZE), "one_size").otherwise("alpha")
    return F.when(F.coalesce(size, F.lit("")) == "", "none").otherwise(F.coalesce(first_match(size, SIZE_SYSTEMS, None), named))


def parse_tags(tags: Column) -> Column:
    """A comma-separated list as an array, trimmed, without empties."""
    return F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != "")


def forced_unavailable(tags: Column) -> Column:
    """Whether a tag says that the product is out, whatever its case and ends."""
    return F.coalesce(F.arrays_overlap(F.transform(tags, lambda t: F.lower(F.trim(t))), F.array(*[F.lit(x) for x in FORCED_OUT])), F.lit(False))


def clean_compare_at(compare_at: Column, price: Column) -> Column:
    """The compare-at price as text; null for none, zero or the price itself."""
    return F.when(compare_at.isNull() | compare_at.isin("0.00", "0") | compare_at.eqNullSafe(price), None).otherwise(compare_at)


def to_money(text: Column) -> Column:
    """DECIMAL(10,2); null for what is no number."""
    return text.try_cast("decimal(10,2)")


def discount_per_cent(price: Column, compare_at: Column) -> Column:
    """Whole per cent off; null unless the compare-at price is above the price."""
    return F.when(compare_at > price, F.floor((compare_at - price) / compare_at * 100 + 0.5).cast("long"))


def option_value(options: Column, values: Column, word: str) -> Column:
    """Of an array of option names and one of values, the value whose name contains the word; the last such wins."""
    pairs = F.filter(F.arrays_zip(options.alias("n"), values.alias("v")), lambda x: F.lower(x["n"]).contains(word))
    return F.try_element_at(pairs, F.lit(-1))["v"]


def pieces(description: Column) -> Column:
    """Array of (piece_name, length_meters, fabric) that a description lists, as in 'Shirt: 3 meter Lawn'; (?i), repeated."""
    pattern = F.lit(r"(?i)(shirt|trouser|dupatta)\s*:\s*(\d+(?:\.\d+)?)\s*(?:m|meters?)\b(?:\s+(lawn|cotton|khaddar|chiffon))?")
    group = lambda i: F.regexp_extract_all(description, pattern, F.lit(i))
    zipped = F.arrays_zip(group(1).alias("piece_name"), group(2).alias("length"), group(3).alias("fabric"))
    return F.transform(zipped, lambda x: F.struct(F.initcap(x["piece_name"]).alias("piece_name"), x["length"].try_cast("decimal(4,1)").alias("length_meters"), F.nullif(F.initcap(x["fabric"]), F.lit("")).alias("fabric")))


def product_url(base: Column, handle: Column) -> Column:
    return F.when(F.coalesce(handle, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("/products/"), handle))


def embedding_text(*parts: Column, most: int = 8000) -> Column:
    """The non-empty parts joined by '. ', cut."""
    return F.substring(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ". "), 1, most)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]+", "-")


def valid_email(address: Column) -> Column:
    """Whether the trimmed address has at most 254 characters, no white space, one at sign with something before it, and behind it a dot that is neither first nor last."""
    bare = F.trim(address)
    sides = F.split(bare, "@")
    host = F.try_element_at(sides, F.lit(2))
    inner = F.substring(host, F.lit(2), F.greatest(F.length(host) - 2, F.lit(0)))
    ok = (F.length(bare) <= 254) & (F.size(sides) == 2) & (F.try_element_at(sides, F.lit(1)) != "") & inner.contains(".") & (F.regexp_count(bare, F.lit(r"\s")) == 0)
    return F.coalesce(ok, F.lit(False))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern that is found in the text."""
    out = None
    for pattern, label in rules:
        test = F.coalesce(text.rlike(pattern), F.lit(False))
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(default) if out is None else out.otherwise(default)


def word_count(text: Column) -> Column:
    """Words of a trimmed title; zero for an empty one."""
    t = F.trim(text)
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def option_roles(names: Column, words: list[str]) -> Column:
    """The option names, in lower case and without repeats, that are among the words."""
    return F.array_intersect(F.transform(names, lambda n: F.lower(F.trim(n))), F.array(*[F.lit(w) for w in words]))
