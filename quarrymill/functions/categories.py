"""The category tree as data: leaves with the genders that have them, laid out as an adjacency list with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Genders by their letter, the leaves of each branch and sub-branch with the genders that have them, and what
# editors hide.
GENDERS = {"M": "Men", "W": "Women", "B": "Boys", "G": "Girls", "U": "Unisex"}
LEAVES = """
Western/Upperwear: T-Shirt MWBGU, Polo MWBGU, Top WG, Shirt MWBGU, Jacket MWBGU, Vest MWBGU, Sweatshirt MWBGU, Hoodie MWBGU, Sweater MWBGU, Dress WGU, Tank Top MWBGU, Jumpsuit WBG
Western/Bottomwear: Trouser MWBGU, Cargo Trouser MWBGU, Jeans MWBGU, Shorts MWBGU, Joggers MWBGU, Tights MWG, Skirt WG
Western/Suits & Sets: Co-ord Set MWBG, Tracksuit MWG
Western/Formalwear: Formal Suit MB
Western/Footwear: Shoes MWBGU, Sandals W
Eastern/Stitched: Kurti WG, Kurta MWBGU, Shalwar Kameez MWBGU, Kurta Set MWBGU, Waistcoat MWBGU, Sherwani MB
Eastern/Unstitched: 1-Piece MWU, 2-Piece MWBGU, 3-Piece MWU, Saree W, Suit MWBGU
Accessories: Belt MWBGU, Tie MU, Cap MWBGU, Wallet MWBGU, Cufflink MU, Watch MWBGU, Sunglasses MWBGU, Jewelry MWGU, Underwear MWBGU, Socks MWBGU, Bag MWBGU, Shawl MWU, Keychain MW, Scarf MWBGU, Pocket Square MWBGU
Fragrance & Beauty: Perfume MWBGU
""".strip()
#: A rule: the category by its path, how far it reaches (itself, all below it, or its children of some names), what a text must
#: hold (by column, any of the words), and what the title must not.
HIDDEN = [
    ("Women > Western > Bottomwear > Shorts", "self", [], {}, []),
    ("Women > Western > Bottomwear > Tights", "self", [], {}, []),
    ("Women > Accessories > Underwear", "self", [], {}, []),
    ("Women > Western > Upperwear > Tank Top", "self", [], {}, []),
    ("Women", "below", [], {"title": ["sleeveless", "spaghetti strap"], "description": ["sleeveless", "spaghetti strap"], "raw": ["sleeveless", "spaghetti strap"]}, ["vest", "gilet", "bodywarmer"]),
    ("Women > Western > Upperwear", "children", ["Shirt", "T-Shirt", "Sweatshirt", "Hoodie", "Sweater", "Polo"], {"title": ["crop"], "description": ["cropped"], "raw": ["cropped"]}, []),
]
# End of the fixed values.

LEVELS = ("gender", "branch", "sub", "leaf")


def leaf_rows() -> list[tuple[str, str, str, str]]:
    """(branch, sub, leaf, genders' letters); sub is empty where the branch has none."""
    out = []
    for line in LEAVES.split("\n"):
        place, names = line.split(": ")
        branch, _, sub = place.partition("/")
        out += [(branch, sub, *name.rsplit(" ", 1)) for name in names.split(", ")]
    return out


def leaf_names() -> set[tuple[str, str, str, str]]:
    """(gender, branch, sub, leaf) of every leaf."""
    return {(GENDERS[g], branch, sub, leaf) for branch, sub, leaf, letters in leaf_rows() for g in letters}


def _slug(name: Column, leaf: Column) -> Column:
    return F.when(leaf, F.replace(F.lower(name), F.lit(" "), F.lit("-"))).otherwise(F.regexp_replace(F.lower(name), "[^a-z]+", "-"))


def stable_id(path: Column) -> Column:
    """A node's id: 63 bits of a hash of its path, so it stays whatever else the tree gains or loses."""
    return F.xxhash64(path).bitwiseAND(F.lit(2**63 - 1))


def categories(spark: SparkSession) -> DataFrame:
    """id, parent_id, name, slug, path, level (1 to 4), is_leaf, and gender, branch, sub, leaf (null above them)."""
    from quarrymill.functions.literals import values

    pairs = [F.lit(x) for item in GENDERS.items() for x in item]
    rows = values(spark, leaf_rows(), ["branch", "sub", "leaf", "letters"])
    rows = rows.select(F.explode(F.split("letters", "")).alias("g"), "branch", F.nullif("sub", F.lit("")).alias("sub"), "leaf").where("g <> ''").withColumn("gender", F.element_at(F.create_map(*pairs), F.col("g")))
    # a leaf stands for the nodes on its way down; levels that a branch lacks are skipped
    names = F.array_compact(F.array(*LEVELS))
    depth = lambda up: [F.when(F.lit(LEVELS.index(c) <= up), F.col(c)).alias(c) for c in LEVELS]
    ways = F.array_compact(F.array(*[F.when(F.col(LEVELS[up]).isNotNull(), F.struct(*depth(up), F.lit(up == 3).alias("is_leaf"))) for up in range(4)]))
    nodes = rows.select(F.explode(ways).alias("x")).select("x.*").distinct().withColumn("names", names)
    path = F.array_join("names", " > ")
    up = F.when(F.size("names") > 1, F.array_join(F.slice("names", F.lit(1), F.size("names") - 1), " > "))
    return nodes.select(
        stable_id(path).alias("id"), F.when(up.isNotNull(), stable_id(up)).alias("parent_id"), F.element_at("names", -1).alias("name"), _slug(F.element_at("names", -1), F.col("is_leaf")).alias("slug"),
        path.alias("path"), F.size("names").alias("level"), "is_leaf", *LEVELS,
    )


def leaves(tree: DataFrame) -> DataFrame:
    """The lookup that places classes: gender, branch, sub, leaf, category_id, with nulls above a leaf."""
    return tree.select(*LEVELS, F.col("id").alias("category_id"))


def emitted() -> set[tuple[str, str | None, str]]:
    """(branch, sub, leaf) of every label that a rule of the classifier gives."""
    from quarrymill.functions import classify as c

    upper = {("Western", "Upperwear", x[3]) for x in c.LEAVES["upper"] if x[3]} | {("Western", "Upperwear", x) for x in ("Shirt", "Vest", "Jumpsuit")}
    bottom = {("Western", "Bottomwear", x[3]) for x in c.LEAVES["bottom"]} | {("Western", "Bottomwear", x) for x in ("Joggers", "Tights", "Skirt")}
    stitched = {("Eastern", "Stitched", x[3]) for x in c.LEAVES["stitched"]}
    unstitched = {("Eastern", "Unstitched", x) for x in ("1-Piece", "2-Piece", "3-Piece", "Saree", "Suit")}
    things = {("Accessories", None, leaf) for _, leaf in c.ACCESSORY_LEAVES} | {("Accessories", None, x) for x in ("Underwear", "Scarf", "Bag")}
    rest = {("Western", "Footwear", "Shoes"), ("Western", "Footwear", "Sandals"), ("Western", "Suits & Sets", "Tracksuit"), ("Western", "Suits & Sets", "Co-ord Set"), ("Western", "Formalwear", "Formal Suit"), ("Fragrance & Beauty", None, "Perfume")}
    return upper | bottom | stitched | unstitched | things | rest


def unplaced(classes: DataFrame, tree: DataFrame) -> DataFrame:
    """gender, branch, sub, leaf, n: the classes that have no leaf of their own in the tree and so fall back to a branch or gender; what an audit lists."""
    have = tree.where("is_leaf").select(*[F.coalesce(c, F.lit("")).alias(f"t_{c}") for c in LEVELS])
    found = classes.groupBy(*LEVELS).agg(F.count("*").alias("n"))
    same = [F.coalesce(c, F.lit("")) == F.col(f"t_{c}") for c in LEVELS]
    return found.join(have, same, "left_anti")
