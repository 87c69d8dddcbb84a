"""Options and the prototype's classifier in cases, and the evaluator of rule sets."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import prototype as p
from quarrymill.functions.rules import decide


@pytest.mark.parametrize("pairs,colors,sizes", [
    ([("Color", "Black"), ("colour", "x"), ("Size", "xl"), ("Fit", "Slim")], ["Black"], ["XL"]),
    ([("Title", "S"), ("Title", "30"), ("Title", "Stripes")], [], ["S", "30", "Stripes"]),  # half and more are sizes
    ([("Title", "Navy"), ("Title", "stripes")], ["Navy", "stripes"], []),  # exactly half are colours
    ([("Title", "S"), ("Title", "Navy"), ("Title", "x y"), ("Title", "z")], [], []),  # a quarter each
    ([("Title", "M"), ("title ", "Navy")], [], ["M", "Navy"]),  # sizes are asked first
    ([("Title", "Default Title")], [], []),
    ([("Title", None), (None, "Black"), ("", "M")], [], []),
    ([("Size", "12 Y"), ("Size", "12Y"), ("Size", "12y"), ("SIZE", "ONE SIZE")], [], ["12y", "One Size"]),
    ([("Color", "NAVY"), ("Color", "Navy"), ("Color", "X")], ["Navy", "X"], []),
    ([("Color Size", "M")], ["M"], []),
    ([], [], []),
    (None, [], []),
])
def test_option_axes(spark, pairs, colors, sizes):
    rows = spark.createDataFrame([(pairs,)], "pairs array<struct<name:string,value:string>>")
    got = rows.select(p.option_axes(F.col("pairs")).alias("x")).first().x
    assert (got.colors, got.sizes) == (colors, sizes)


def test_option_axes_of_many_pairs(spark):
    """The time grows with the pairs, not with their square, and each pair is looked at once: no pattern is planned again for each use of its outcome."""
    found = p.option_axes(F.expr("transform(sequence(1, 20000), i -> struct(if(i % 3 = 0, 'Title', 'Color') as name, concat('NAVY ', i % 7) as value))"))
    assert str(found._jc).count("regexp_replace") < 20
    x = spark.range(1).select(found.alias("x")).first().x
    assert x.sizes == [] and sorted(x.colors) == [f"Navy {k}" for k in range(7)]


CASES = [
    (("", "Semi-Stitched Khaddar Kurti", "", "", ""), ("Unisex", "Eastern", "Semi-Stitched", "Kurti")),
    (("", "Un-Stitched Unstitched 2 piece", "", "", "monark"), ("Men", "Eastern", "Unstitched", "2-Piece")),
    (("Body Spray", "Musk", "", "", ""), ("Unisex", "Fragrance & Beauty", None, "Deodorant")),
    (("", "Khaddar suit length", "", "Ladies", ""), ("Women", "Eastern", "Stitched", "Kurta")),
    (("", "Suit", "", "", ""), ("Unisex", "Western", "Suits & Sets", "Formal Suit")),
    (("", "Suit by the length", "", "", ""), ("Unisex", "Western", "Upperwear", "Apparel")),
    (("", "Length Suit", "", "", ""), ("Unisex", "Western", "Suits & Sets", "Formal Suit")),
    (("", "Kurta with Sandals", "", "", ""), ("Unisex", "Western", "Footwear", "Sandals")),
    (("", "Junior Boy Graphic Tee", "girls", "", ""), ("Boys", "Western", "Upperwear", "Graphic Tee")),
    ((None, None, None, None, None), ("Unisex", "Western", "Upperwear", "Apparel")),
]


@pytest.mark.parametrize("given,want", CASES)
def test_prototype_classes(spark, given, want):
    rows = spark.createDataFrame([given], "kind string, title string, tags string, vendor string, store string")
    got = rows.select(p.classify_prototype(*[F.col(x) for x in rows.columns]).alias("x")).first().x
    assert tuple(got) == want


def test_evaluator(spark):
    """All, some and none; the first rule that holds; one without tests always does; none that holds gives null."""
    rules = [(["a", "b"], [], [], "both"), ([], ["a", "b"], ["c"], "one"), (["c"], [], [], "c")]
    rows = spark.createDataFrame([(1, True, True, True), (2, True, False, False), (3, False, True, True), (4, False, False, False)], "i int, a boolean, b boolean, c boolean")
    out = {r.i: (r.x, r.y, r.z) for r in rows.select("i", decide(rules, F.col, F.lit).alias("x"), decide([*rules, ([], [], [], "rest"), (["a"], [], [], "never")], F.col, F.lit).alias("y"), decide([], F.col, F.lit).alias("z")).collect()}
    assert out == {1: ("both",) * 2 + (None,), 2: ("one",) * 2 + (None,), 3: ("c",) * 2 + (None,), 4: (None, "rest", None)}
    assert rows.select(decide([([], [], [], "always")], F.col, F.lit).alias("x")).distinct().count() == 1
