"""The category tree: its shape, stable ids, the guard that rules emit leaves it has, and editorial hiding by name path."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import categories as c
from quarrymill.operators import maintain, predicates, tree


@pytest.fixture(scope="module")
def nodes(spark):
    df = c.categories(spark)
    return spark.createDataFrame(df.collect(), df.schema).cache()


def test_shape(nodes):
    rows = {r.path: r for r in nodes.collect()}
    assert len(rows) == 263 and len({r.id for r in rows.values()}) == 263
    assert sorted(p for p, r in rows.items() if r.parent_id is None) == ["Boys", "Girls", "Men", "Unisex", "Women"]
    ids = {r.id: p for p, r in rows.items()}
    assert all(ids[r.parent_id] == p.rsplit(" > ", 1)[0] for p, r in rows.items() if r.parent_id is not None)
    assert {r.slug for r in rows.values()} >= {"men", "fragrance-beauty", "suits-sets", "co-ord-set", "1-piece", "t-shirt", "pocket-square"}
    assert rows["Women > Accessories > Bag"].level == 3 and rows["Women > Accessories > Bag"].is_leaf and not rows["Women > Eastern"].is_leaf
    # a name that is a leaf here and nothing there
    assert "Men > Western > Bottomwear > Skirt" not in rows and "Unisex > Western > Suits & Sets" not in rows and "Women > Western > Formalwear" not in rows
    assert sum(r.is_leaf for r in rows.values()) == len(c.leaf_names())


def test_ids_stay_when_the_tree_grows(spark, nodes, monkeypatch):
    monkeypatch.setattr(c, "LEAVES", "Western/Upperwear: Cape MWB, Anorak U\n" + c.LEAVES)
    grown = {r.path: r.id for r in c.categories(spark).collect()}
    assert all(grown[r.path] == r.id for r in nodes.collect()) and len(grown) == 267


def test_every_label_that_a_rule_gives_is_a_leaf():
    """Of some gender at least; and those that were missing once are there for the genders that need them."""
    have = c.leaf_names()
    assert {(b, s or "", leaf) for b, s, leaf in c.emitted()} <= {x[1:] for x in have}
    for gender, branch, sub, leaf in [
        ("Women", "Eastern", "Stitched", "Kurta"), ("Women", "Eastern", "Stitched", "Kurta Set"), ("Women", "Accessories", "", "Keychain"), ("Men", "Accessories", "", "Keychain"), ("Unisex", "Western", "Footwear", "Shoes"),
        ("Unisex", "Western", "Upperwear", "Dress"), ("Boys", "Western", "Upperwear", "Jumpsuit"), ("Girls", "Western", "Bottomwear", "Skirt"), ("Men", "Western", "Upperwear", "Tank Top"), ("Women", "Accessories", "", "Pocket Square"),
        ("Men", "Western", "Formalwear", "Formal Suit"), ("Boys", "Western", "Formalwear", "Formal Suit"), ("Girls", "Western", "Suits & Sets", "Tracksuit"), ("Boys", "Eastern", "Unstitched", "2-Piece"), ("Unisex", "Eastern", "Unstitched", "3-Piece"),
    ]:
        assert (gender, branch, sub, leaf) in have


def test_unplaced(spark, nodes):
    rows = spark.createDataFrame([("Men", "Western", "Upperwear", "Polo"), ("Men", "Western", "Upperwear", "Dress"), ("Men", "Western", "Upperwear", "Dress"), ("Men", "Accessories", None, "Belt"), ("Boys", "Accessories", None, "Tie")], "gender string, branch string, sub string, leaf string")
    assert {(r.gender, r.leaf, r.n) for r in c.unplaced(rows, nodes).collect()} == {("Men", "Dress", 2), ("Boys", "Tie", 1)}


HIDES = [
    ("Women > Western > Bottomwear > Shorts", "plain", None, None, True),
    ("Girls > Western > Bottomwear > Shorts", "plain", None, None, False),
    ("Women > Western > Upperwear > Tank Top", "vest", None, None, True),  # the whole leaf, whatever its title
    ("Women > Western > Upperwear > Jacket", "Puffer", "a SLEEVELESS design", None, True),
    ("Women > Western > Upperwear > Jacket", "Down Gilet", "a sleeveless design", None, False),
    ("Women", "Top", None, "spaghetti straps", True),  # the node itself
    ("Men > Western > Upperwear > Shirt", "sleeveless", "sleeveless", "sleeveless", False),
    ("Women > Western > Upperwear > Shirt", "Crop Shirt", None, None, True),
    ("Women > Western > Upperwear > Hoodie", "Hoodie", "cropped hem", None, True),
    ("Women > Western > Upperwear > Hoodie", "Hoodie", "crop of cotton", None, False),  # only the title counts for this word
    ("Women > Western > Upperwear > Jacket", "Cropped Jacket", "cropped", None, False),
    ("Women > Western > Bottomwear > Jeans", "Cropped Jeans", None, None, False),
    (None, "sleeveless", None, None, False),
]


def test_hidden_and_shown_again(spark, nodes):
    ids = {r.path: r.id for r in nodes.collect()}
    rows = spark.createDataFrame([(i, ids.get(p), t, d, r, True) for i, (p, t, d, r, _) in enumerate(HIDES)], "i int, category_id long, title string, description string, raw string, is_browsable boolean")
    reached = predicates.rule_categories(tree.closure(nodes), nodes, nodes, c.HIDDEN)
    got = predicates.hidden_by(rows, "category_id", reached, c.HIDDEN)
    assert {r.i: r.hidden for r in got.collect()} == {i: x[-1] for i, x in enumerate(HIDES)}
    assert got.columns == [*rows.columns, "hidden"]
    hidden, n = maintain.set_flag(got, "is_browsable", F.col("hidden"))
    assert n.first().n == sum(x[-1] for x in HIDES) and {r.i for r in hidden.where("not is_browsable").collect()} == {i for i, x in enumerate(HIDES) if x[-1]}
    shown, n = maintain.set_flag(hidden, "is_browsable", F.col("hidden"), undo=True)
    assert n.first().n == sum(x[-1] for x in HIDES) and shown.where("not is_browsable").count() == 0
    lost = predicates.rule_categories(tree.closure(nodes), nodes, nodes, [("Women > Nowhere", "below", [], {}, [])])
    assert lost.count() == 0
