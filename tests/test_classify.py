"""Precedence decisions of the classifier: each row is an input and what it must become."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.classify import classify, has_kids_sizing

# title, product type, vendor, description, gender or None, leaf (None: excluded)
CASES = [
    ("Spider Man Tee", "", "BOYS", "", "Boys", "T-Shirt"),
    ("Basic Barrel Jeans", "Shorts", "", "", None, "Jeans"),
    ("String Sports Shoes", "Jeans", "", "", None, "Shoes"),
    ("Basic Denim Jacket", "Jeans", "", "", None, "Jacket"),
    ("Mesh Lace-Up Trainers", "Men Joggers Shoes", "", "", "Men", "Shoes"),
    ("Men Trainers Jogger", "", "", "", "Men", "Joggers"),
    ("Multi-Functional Backpack", "WALLETS", "", "", None, "Bag"),
    ("Character Graphic Sweatshirt", "TEES", "", "", None, "Sweatshirt"),
    ("SHORT BLOCK HEEL", "", "", "", None, "Shoes"),
    ("Short Dress", "", "", "", None, "Dress"),
    ("Women Shorts Body Blazer", "", "", "", "Women", "Jacket"),
    ("Denim jorts", "", "", "", None, "Shorts"),
    ("Paper Bag Fit Jeans", "", "", "", None, "Jeans"),
    ("Waist Tie Top", "", "", "", None, "Shirt"),
    ("Furor Jeans Keychain", "", "", "", None, "Keychain"),
    ("Black With Brown Contrast Leather Belt", "", "", "", None, "Belt"),
    ("Jeans With Belt Detail", "", "", "", None, "Jeans"),
    ("Flip Flops T-Shirt", "", "", "", None, "T-Shirt"),
    ("Combo Hoodie", "", "", "", None, "Hoodie"),
    ("Printed Dupatta", "", "", "", None, "Scarf"),
    ("Denim Cargo Trouser", "", "", "", None, "Cargo Trouser"),
    ("Cargo Shorts", "", "", "", None, "Shorts"),
    ("Tracksuit Zipper Jacket", "", "", "", None, "Jacket"),
    ("Hoodie Tracksuit", "", "", "", None, "Tracksuit"),
    ("Plain Shirt 2PC", "", "", "", None, "Co-ord Set"),
    ("Cobra Print Shirt", "", "", "", None, "Shirt"),
    ("Sando Vest", "", "", "", None, "Underwear"),
    ("Quilted Vest", "", "", "", None, "Vest"),
    ("Gym Vest", "", "", "", None, "Tank Top"),
    ("Sweater Vest", "", "", "", None, "Sweater"),
    ("Short-Sleeve Shirt", "", "", "", None, "Shirt"),
    ("Short Coat", "", "", "", None, "Jacket"),
    ("Jacket With Hoodie", "", "", "", None, "Jacket"),
    ("Hooded Check Shirt", "", "", "", None, "Shirt"),
    ("Formal Suit - Navy", "", "Men", "", "Men", "Formal Suit"),
    ("Faux Leather Waistcoat", "", "", "", None, "Vest"),
    ("French Grey Suit", "", "", "goes with a kurta", None, "Kurta"),
    ("Embroidered Kurti", "", "Men", "", "Women", "Kurti"),
    ("Unstitched Lawn Suit 3 Pc", "", "", "", None, "3-Piece"),
    ("Eau Perfume", "", "", "", None, "Perfume"),
    ("Test", "", "", "", None, None),
    ("Gift Card", "", "", "", None, None),
    ("Large", "Shopping Bags", "", "", None, None),
    ("Women Sandals", "", "", "", "Women", "Sandals"),
    ("Knitwear for Women", "", "", "unisex; for women", "Women", "Shirt"),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(i, t, p, "", v, "", d, False) for i, (t, p, v, d, _, _) in enumerate(CASES)]
    rows += [(1000, None, None, None, None, None, None, None), (1001, "Polo", "", "", "", "furor", "", False), (1002, "Polo", "", "", "", "", "", True)]
    df = spark.createDataFrame(rows, "i int, title string, product_type string, tags string, vendor string, store string, description string, kids_sizing boolean")
    return {r.i: r["class"] for r in classify(df).collect()}


def test_cases(classified):
    wrong = []
    for i, (title, kind, _, _, gender, leaf) in enumerate(CASES):
        got = classified[i]
        if (got and got.leaf) != leaf or (gender and got.gender != gender):
            wrong.append((title, kind, got, gender, leaf))
    assert not wrong


def test_defaults(classified):
    assert classified[1000].leaf == "Shirt" and classified[1000].gender == "Unisex"
    assert classified[1001].gender == "Men" and classified[1002].gender == "Unisex"


def test_kids_sizing(spark):
    rows = spark.createDataFrame([(["S", "3-4Y"],), (["T2"],), (["S", None],), (None,)], "s array<string>")
    assert [r[0] for r in rows.select(has_kids_sizing(F.col("s"))).collect()] == [True, True, False, False]


def test_full_query_reads_whole_texts(spark, tmp_path):
    """A keyword decides wherever it stands in the document; without one the suit stays western."""
    from quarrymill.plans.texts import classify_full

    told = {5: "goes with a kurta", 13: "plain words " * 40 + "goes with a kurta", 21: "plain words " * 400 + "goes with a kurta", 29: "plain words " * 400, 37: None}
    spark.createDataFrame([(k, "French Grey", "", "Brand") for k in told], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(list(told.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.p_partkey: (r.branch, r.leaf) for r in classify_full(spark, str(tmp_path)).collect()}
    assert got[5] == got[13] == got[21] == ("Eastern", "Kurta")
    assert got[29] == got[37] and got[29][0] == "Western"


def test_products_leave_no_rules_in_a_filter(spark):
    """The rows that are no products go by a filter of their own, and those left are classified once."""
    from quarrymill.functions.classify import products

    rows = spark.createDataFrame([(i, t, "", "", "", "", "", False) for i, t in enumerate(("Gift Card", "Polo", "Test", None))], "i int, title string, product_type string, tags string, vendor string, store string, description string, kids_sizing boolean")
    out = products(rows).select("i", "class.*")
    assert {r.i: r.leaf for r in out.collect()} == {r.i: r.leaf for r in classify(rows).where("class is not null").select("i", "class.*").collect()} == {1: "Polo", 3: "Shirt"}
    plan = products(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("RLIKE") <= 4 for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter"))


def test_placed_parts_are_spread(spark):
    """Parts of one file are dealt out before they are classified, and no filter holds the rules."""
    from quarrymill.plans import registry

    for name in ("editorial_hide", "category_tree", "classes_without_leaf"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [p_partkey" in plan, name
        assert all(line.count("RLIKE") <= 4 for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter")), name
