"""The classifier over garments that touch every rule, with an oracle in SQL.

DuckDB's patterns have no look-around. What a pattern must not stand beside is cut out of the text first there, then
the rest of the pattern is looked for; on these texts that is the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import classify as c
from quarrymill.plans.tables import table

#: Titles, one for each part by its number; together they reach every rule and every leaf.
TITLES = [
    "Basic Polo", "Ribbed Tank Top", "Crew Tee", "Vest Tee", "Quilted Gilet", "Zip Hoodie", "Jacket With Hoodie", "Sweat Shirt Plain", "Turtleneck Knit", "Printed Tunic", "Leather Jacket", "Wool Coat", "Maxi Dress", "Dress Shirt",
    "Hooded Top", "Hooded Check Shirt", "Gym Vest", "Knit Vest", "Puffer Vest", "Sando Vest", "Oxford Shirt", "Cargo Shorts", "Cargo Trouser", "Barrel Jeans", "Blue Denim", "Denim Jacket", "Denim Terry Set", "Chino Pants",
    "Short Sleeve Shirt", "Short Block Heels", "Running Joggers", "Joggers Shoes", "Sports Trainers", "Women Sandals", "Slippers T-Shirt", "Gym Tights", "Pleated Skirt", "Denim Jumpsuit", "Hoodie Tracksuit", "Tracksuit Zipper Jacket",
    "Three Piece Suit", "Plain Shirt 2PC", "Co-ord Linen", "Combo Hoodie", "Combo Pack", "Formal Suit Navy", "Linen Blazers Suit", "Prince Coat Suit", "Kurta Shalwar", "Kurta", "Kurti Printed", "Shalwar Kameez", "Lehenga Choli",
    "Silk Saree", "Sherwani Gold", "Waistcoat Festive", "Faux Leather Waistcoat", "Unstitched Lawn 3 Piece", "Unstitched Shirt Dupatta", "Un-stitched Cloth", "Shirt Trousers Lawn", "Printed Dupatta", "Wool Scarf", "Leather Belt",
    "Silk Tie", "Waist Tie Top", "Tie Dye Tee", "Baseball Cap", "Cap Sleeve Tee", "Steel Watch", "Black Watch Shirt", "Tote Bags", "Paper Bag Jeans", "Bifold Wallet", "Ankle Socks", "Sock-Fit Boots", "Shawl", "Shawl Collar Sweater",
    "Jeans With Belt Detail", "Pocket Square", "Keychain", "Cufflinks", "Sunglasses", "Silver Necklace", "Eau Perfume", "Boxers", "Undergarment Vest", "Gift Card", "Test", "Shopping Bag", "Girls Frock", "Men Kurti", "Open Knit Vest",
]
KINDS = ["", "Men", "Women Tops", "Jeans", "Boys", "TEES", "Girls Eastern"]
SAID = ["", "cotton", "fit type: shirt and trouser, fit type: regular", "goes with a kurta", "unisex; a 2 piece set", "single breasted, formal suit", "unstitched cloth", "chest, and is wearing a suit", "a saree", "goes with a kurta, men and women"]
TAGS = ["", "women, men", "kids", "winter"]


def _rows(s, d):
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.expr(at) % len(xs) + 1).cast("int"))
    return table(s, d, "part").select(
        "p_partkey", pick(TITLES, "p_partkey").alias("title"), pick(KINDS, "p_partkey div 3").alias("product_type"), pick(TAGS, "p_partkey div 5").alias("tags"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).when(F.col("p_partkey") % 11 == 0, F.lit("Boys Club")).alias("vendor"),
        F.when(F.col("p_partkey") % 6 == 0, "furor").alias("store"), pick(SAID, "p_partkey div 2").alias("description"), (F.col("p_partkey") % 29 == 0).alias("kids_sizing"),
    )


def classify_rules(s, d):
    """Every rule of the classifier; excluded rows have nulls."""
    return c.classify(_rows(s, d)).select("p_partkey", *[F.col(f"class.{x}").alias(x) for x in ("gender", "branch", "sub", "leaf", "style", "construction", "piece_count")])


# The oracle

#: Patterns with look-around as two: what goes first, and what is then looked for.
_CUT = {
    "shorts": (r"\bshorts?\b([\s-]*sleeve(s|d)?\b|(\s+\w+){0,2}\s+(coat|dress|jacket|blazer|heels?)\b)", r"\bjorts?\b|\bshorts?\b"),
    "footwear": (r"\b(shoes?|sandals?|sneakers?|heels?|boots?|slippers?|trainers?)\b(\s+\w+){0,2}\s+(shirts?|tees?|t-shirts?|polos?|hoodies?|sweatshirts?|sweaters?)\b", r"\b(shoes?|sandals?|sneakers?|heels?|boots?|slippers?|trainers?)\b"),
    "coord": (r"\bcombos?\b\s+(hoodies?|tees?|t-shirts?|shirts?|polos?|sweatshirts?|sweaters?|jackets?)\b", r"\bco-?ords?\b|\bsuits?\b|\bpantsuits?\b|\bnightsuits?\b|\bcombos?\b"),
    "dress": (r"\bdress\b\s+(\w+\s+)?shirts?\b", r"\bdress\b|\bfrock\b"),
    "accessory": (r"\bcaps?\s*sleeves?|\bsocks?-fit\b|paper[\s-]?bags?\b|shawl\s*collar|black\s?watch|watch(es)?\s*maker|(front|hair|waist)\stie\b|\btie(-|\s+up\b|\s*(&|and)?\s*(dye|die)\b)", r"\b(belts?|caps?|hats?|beanies?|wallets?|cufflinks?|sunglass(es)?|jewel(l?ery|ry)?|bracelets?|necklaces?|earrings?|handbags?|clutch(es)?|socks?|key\s*chains?|backpacks?|pocket\s*squares?)\b|\bbags?\b|\btotes?\b|shawl|watch(es)?|\btie\b"),
}
_LEAF_CUT = {"Tie": r"\btie\b", "Cap": r"\bcaps?\b|\bhats?\b|\bbeanies?\b", "Watch": r"\bwatch(es)?\b", "Bag": r"\bbags?\b|\bhandbags?\b|\bbackpacks?\b|\bclutch(es)?\b|\btotes?\b", "Shawl": r"\bshawl\b", "Socks": r"\bsocks?\b"}


def _like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def _cut(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '(?i){pattern}', ' ', 'g')"


def _f(text: str, name: str) -> str:
    if name in _CUT:
        gone, rest = _CUT[name]
        return _like(_cut(text, gone), rest)
    return _like(text, c.PATTERNS[name])


def _h(text: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _case(pairs: list[tuple[str, str]], other: str = "null") -> str:
    return "case " + " ".join(f"when {t} then {v}" for t, v in pairs) + f" else {other} end"


def _spot(what: str, texts: dict[str, str], flags: dict[str, str]) -> str:
    if what[0] == "?":
        return flags[what[1:]]
    place = what[0] if what[0] in "&-" else ""
    what = what[len(place) :]
    return _f(texts[place], what[1:]) if what[0] == "/" else _h(texts[place], what)


def _leaf(group: str, texts: dict[str, str], **flags: str) -> str:
    pairs = []
    for everything, some, nothing, leaf in c.LEAVES[group]:
        tests = [_spot(x, texts, flags) for x in everything] + [f"not {_spot(x, texts, flags)}" for x in nothing] + (["(" + " or ".join(_spot(x, texts, flags) for x in some) + ")"] if some else [])
        pairs.append((" and ".join(tests) or "true", f"'{leaf}'" if leaf else "null"))
    return _case(pairs)


def _accessory(text: str) -> str:
    gone = _CUT["accessory"][0]
    return _case([(_like(_cut(text, gone), _LEAF_CUT.get(leaf, p)), f"'{leaf}'") for p, leaf in c.ACCESSORY_LEAVES])


def _sql() -> str:
    words = lambda t, rules: _case([(_like(t, p), f"'{v}'") for p, v in rules])
    pick = lambda xs, at: "([" + ", ".join(f"'{x}'" for x in xs) + f"])[(({at}) % {len(xs)} + 1)::int]"
    age = f"case when {_f('seller', 'age_only')} or {_f('anywhere', 'age_only')} or kids then 'Unisex' end"
    men = ", ".join(f"'{x}'" for x in c.MEN_STORES)
    gender = f"coalesce({words('seller', c.GENDER_WORDS)}, {words('trim(title)', c.TITLE_STARTS)}, {words('anywhere', c.GENDER_WORDS)}, {age}, case when store in ({men}) then 'Men' end, 'Unisex')"
    both_named = f"{_f('said', 'unisex')} and {_f('called', 'women_words')} and {_f('called', 'men_words')}"
    bare = lambda t: f"case when {_f(t, 'garment_detail')} and {_f(t, 'garment_noun')} then {_cut(t, c.PATTERNS['garment_detail'])} else {t} end"
    denim = lambda t: f"({_f(t, 'denim')} and not {_f(t, 'denim_garment')} and not {_f(t, 'denim_terry')})"
    two = lambda t: f"({_h(t, 'shirt', 'frock')} and {_h(t, 'trouser', 'shalwar')} and len(regexp_extract_all({t}, '(?i){c.PATTERNS['fit_type']}')) >= 2)"
    lower_t = f"({_f('title', 'trouser')} or {_f('title', 'shorts')} or {denim('title')})"
    shoes_t, eastern, unst = _f("title", "footwear"), _f("blob", "eastern"), _f("blob", "unstitched")
    named = "least(3, " + " + ".join(f"contains(blob, '{w}')::int" for w in c.NAMED_PIECES) + ")"
    stitched = lambda more, parts: _leaf("stitched", {"": "blob", "&": more}, two_parts=parts)
    east = _case([(f"pieces is not null and {unst}", "pieces || '-Piece'"), (_h("blob", "saree", "sari"), "'Saree'"), (unst, "'Suit'")], stitched("blob", "false"))
    cloth = f"({unst} or {_f('more', 'unstitched')})"
    set_leaf = _case([(cloth, "'Suit'"), (f"({_h('more', 'saree', 'sari')} or {_h('blob', 'saree', 'sari')})", "'Saree'")], stitched("both_", two("more")))
    set_east = f"({_f('more', 'eastern_signal')} or {_f('more', 'unstitched')} or {two('said')} or {_f('blob', 'prince')})"
    formal = f"(gender in ('Men', 'Boys') and ({_f('both_', 'formal')} or ({_f('both_', 'suit')} and {_f('both_', 'chest')})))"
    coord = f"({_f('blob', 'coord')} or {_f('title', 'coord_title')})"
    female = "gender in ('Women', 'Girls')"
    hood = lambda t: _cut(t, c.PATTERNS["hood_detail"])
    upper = "coalesce(" + ", ".join(_leaf("upper", {"": t, "-": hood(t)}, female=female) for t in ("title", "blob")) + ", 'Shirt')"
    bottom = lambda t: _leaf("bottom", {"": t}, denim=denim(t))
    under = f"({_f('blob', 'vest')} and {_f('worn', 'vest_under')} and not {_f('worn', 'vest_outer')})"
    west = "'western', 'ready_to_wear'"
    row = lambda g, branch, sub, leaf, rest, pieces="null": f"{{gender: {g}, branch: '{branch}', sub: {sub}, leaf: {leaf}, style: {rest.split(', ')[0]}, construction: {', '.join(rest.split(', ')[1:])}, piece_count: {pieces}::int}}"
    women = lambda leaf: f"case when {leaf} = 'Kurti' and gender = 'Boys' then 'Girls' when {leaf} = 'Kurti' and gender = 'Men' then 'Women' else gender end"
    none = "'western', 'not_applicable'"
    sewn, made = (lambda x: f"case when {x} then 'Unstitched' else 'Stitched' end"), (lambda x: f"case when {x} then 'unstitched_fabric' else 'ready_to_wear' end")
    rules = [
        (f"{_f('title', 'gift_card')} or {_f('title', 'test')} or {_f('title', 'shopping_bag')} or {_f('kind', 'shopping_bag')}", "null"),
        (_f("blob", "fragrance"), row("gender", "Fragrance & Beauty", "null", "'Perfume'", "'not_applicable', 'not_applicable'")),
        (f"({_f('blob', 'underwear')} or {under}) and not {eastern}", row("gender", "Accessories", "null", "'Underwear'", none)),
        (f"{_f('things', 'accessory')} and not {eastern}", row("gender", "Accessories", "null", f"coalesce({_accessory('thing')}, {_accessory('things')}, 'Bag')", none)),
        (f"{_f('things', 'scarf')} and not {_f('blob', 'eastern_garment')} and not {unst}", row("gender", "Accessories", "null", "'Scarf'", none)),
        (f"{_h('blob', 'waistcoat')} and {_f('both_', 'western_waistcoat')} and not {_f('both_', 'waistcoat_companion')}", row("gender", "Western", "'Upperwear'", "'Vest'", west)),
        (f"{eastern} or {unst} or {_f('blob', 'shirt_trouser')}", row(women(f"({east})"), "Eastern", sewn(unst), east, f"'eastern', {made(unst)}", "pieces")),
        (f"{_f('blob', 'joggers')} and not ({shoes_t} and not {_f('title', 'joggers')})", row("gender", "Western", "'Bottomwear'", "'Joggers'", west)),
        (_f("blob", "tights"), row("gender", "Western", "'Bottomwear'", "'Tights'", west)),
        (_f("blob", "skirt"), row("gender", "Western", "'Bottomwear'", "'Skirt'", west)),
        (lower_t, row("gender", "Western", "'Bottomwear'", bottom("title"), west)),
        (f"({_f('blob', 'trouser')} or {_f('blob', 'shorts')} or {denim('blob')}) and not {shoes_t} and not ({_f('title', 'jacket_words')} and not {lower_t})", row("gender", "Western", "'Bottomwear'", bottom("blob"), west)),
        (_f("blob", "footwear"), row("gender", "Western", "'Footwear'", f"case when gender = 'Women' and {_f('blob', 'sandal')} then 'Sandals' else 'Shoes' end", none)),
        (_f("blob", "jumpsuit"), row("gender", "Western", "'Upperwear'", "'Jumpsuit'", west)),
        (f"{_f('blob', 'tracksuit')} and not {_f('blob', 'tracksuit_single')}", row("gender", "Western", "'Suits & Sets'", "'Tracksuit'", west)),
        (f"{coord} and {set_east}", row(women(f"({set_leaf})"), "Eastern", sewn(cloth), set_leaf, f"'eastern', {made(cloth)}")),
        (f"{coord} and {formal}", row("gender", "Western", "'Formalwear'", "'Formal Suit'", west)),
        (coord, row("gender", "Western", "'Suits & Sets'", "'Co-ord Set'", west)),
    ]
    decided = _case(rules, row("gender", "Western", "'Upperwear'", upper, west))
    return f"""
with raw as (select p_partkey, {pick(TITLES, 'p_partkey')} as t, {pick(KINDS, 'p_partkey // 3')} as k, {pick(TAGS, 'p_partkey // 5')} as g, coalesce(case when p_partkey % 4 = 0 then p_brand when p_partkey % 11 = 0 then 'Boys Club' end, '') as v, case when p_partkey % 6 = 0 then 'furor' end as store, {pick(SAID, 'p_partkey // 2')} as d, p_partkey % 29 = 0 as kids from part),
texts as (select p_partkey, store, kids, k as kind, lower(t) as title, lower(k || ' ' || t) as blob, lower(d) as said, lower(g || ' ' || d) as more, lower(k || ' ' || t) || ' ' || lower(g || ' ' || d) as both_, lower(v || ' ' || k || ' ' || t || ' ' || d) as worn, lower(g || ' ' || t) as called, lower(v) as seller, lower(v || ' ' || g || ' ' || k || ' ' || t) as anywhere from raw),
known as (select *, case when {both_named} then 'Unisex' else {gender} end as gender, {bare('blob')} as things, {bare('title')} as thing,
  coalesce(nullif(regexp_extract(blob || ' ' || said, '(?i){c.PATTERNS['piece_count']}', 1), '')::int, case when {unst} and {named} > 0 then {named} end) as pieces from texts),
decided as (select p_partkey, {decided} as x from known)
select p_partkey, x.gender as gender, x.branch as branch, x.sub as sub, x.leaf as leaf, x.style as style, x.construction as construction, x.piece_count as piece_count from decided
"""


QUERIES = {"classify_rules": (classify_rules, _sql())}
