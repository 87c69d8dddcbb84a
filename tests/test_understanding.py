"""Filters from queries in cases, and the strict check of a struct."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import understanding as u


@pytest.fixture(scope="module")
def known(spark):
    df = u.phrases(spark, spark.createDataFrame([("Royal Tag",), ("ONE (Be-One)",), ("Polo",), ("Furor",)], "name string"))
    return spark.createDataFrame(df.collect(), df.schema).cache()


CASES = {
    "furor jeans": (None, ["Jeans"], None, None, "Furor", [], [], False, ""),
    "Polos / Tees under 3000 knitted wear": (None, ["Polo", "T-Shirt"], None, 3000.0, None, [], [], False, "knitted wear"),
    "cozy warm sweaters for women under Rs. 5,000": ("Women", ["Sweater"], None, 5000.0, None, [], [], False, "cozy warm"),
    "formal kurta for a wedding, men, between 2k and 8000": ("Men", ["Kurta"], 2000.0, 8000.0, None, [], [], False, "formal wedding"),
    "royal tag suits & sets in size XXL": (None, ["Suits & Sets"], None, None, "Royal Tag", ["XXL"], [], False, ""),
    "one be one royal blue discounted": (None, [], None, None, "ONE (Be-One)", [], ["blue"], True, "royal"),
    "polo": (None, [], None, None, "Polo", [], [], False, ""),  # a brand's name comes first
    "kurta set sky blue or blue": (None, ["Kurta Set"], None, None, None, [], ["sky blue", "blue"], False, ""),
    "girls boys s m large": ("Girls", [], None, None, None, ["L"], [], False, "m"),  # a letter alone is no size
    "over 1,500.50 sandals, at most 2k": (None, ["Sandals"], 1500.5, 2000.0, None, [], [], False, ""),
    "": (None, [], None, None, None, [], [], False, ""),
    "!!!": (None, [], None, None, None, [], [], False, ""),
    None: (None, [], None, None, None, [], [], False, ""),
}


def test_filters(spark, known):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, q string")
    got = {r.i: tuple(r)[1:] for r in u.filters(rows, "i", "q", known).collect()}
    for i, (q, want) in enumerate(CASES.items()):
        assert got[i] == want, q
    assert u.filters(rows.limit(0), "i", "q", known).count() == 0


def test_filters_are_spread(spark, known):
    """Queries in one file's task are dealt out before their word runs are made, and runs of words never cross a shuffle."""
    rows = spark.createDataFrame([(i, "navy polos for women") for i in range(40)], "i int, q string").coalesce(1)
    found = u.filters(rows, "i", "q", known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(phrase" not in plan
    assert {(r.gender, *r.categories, *r.colors) for r in found.collect()} == {("Women", "Polo", "navy")}


GOOD = {"gender": "Women", "categories": ["Polo", "Western"], "minPrice": None, "maxPrice": 5000, "brand": None, "sizes": [], "colors": ["blue"], "onSale": False, "semantic_query": "", "response_text": "x \"gender\": 3", "suggested_refinements": []}
BAD = [
    ({}, []), ({"gender": None}, []), ({"gender": "Kids"}, ["gender is unknown"]), ({"categories": ["Polo", "Kilt"]}, ["a category is unknown"]), ({"more": 1}, ["unknown: more"]), ({"brand": ...}, ["missing: brand"]),
    ({"sizes": "M"}, ["sizes is no array"]), ({"onSale": "true"}, ["onSale is no boolean"]), ({"maxPrice": "5000"}, ["maxPrice is no number"]), ({"semantic_query": None}, ["semantic_query is no string"]),
]


def test_problems(spark):
    texts = [json.dumps({k: v for k, v in (GOOD | change).items() if v is not ...}) for change, _ in BAD] + ["[1]", "no json", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    got = {r.i: r.p for r in rows.select("i", u.problems(F.col("a")).alias("p")).collect()}
    assert [got[i] for i in range(len(BAD))] == [want for _, want in BAD]
    assert all(got[len(BAD) + k][0] == "no object" for k in range(3))
