"""Lookups by key read few rows of a table that is clustered by something else; places in an order over a whole set; small scalars."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import maintain, topk


def rows_read(spark, df) -> int:
    """Rows that the scan of a plan gave after row groups were left out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookup_by_id_reads_few_row_groups(spark, tmp_path):
    """20,000 rows in many row groups, laid by category: the ids of each spread over the whole range, so only the bloom filters tell them apart."""
    n = 20_000
    feed = spark.range(n).selectExpr("id", "pmod(hash(id), 50) as category", "repeat(md5(cast(id as string)), 8) as pad").withColumn("at", F.col("id"))
    feed = feed.repartition(4, "category").sortWithinPartitions("category", F.md5(F.col("id").cast("string")))
    bare = maintain.write_version(feed, f"file://{tmp_path}/bare", "1", {"parquet.block.size": str(64 << 10)})
    options = maintain.lookup_options({"id": n // 4}, 64 << 10)
    kept = maintain.write_version(feed, f"file://{tmp_path}/kept", "1", options)
    wanted = F.col("id") == 7777
    plain, quick = (rows_read(spark, spark.read.parquet(p).where(wanted).select("category")) for p in (bare, kept))
    assert spark.read.parquet(kept).where(wanted).count() == 1
    print("rows read:", plain, quick)
    assert 0 < quick < plain / 4
    missing = rows_read(spark, spark.read.parquet(kept).where("id = -5").select("category"))
    assert missing <= plain


def test_full_refresh_with_lookups(spark, tmp_path):
    feed = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "c", 5)], "id long, category string, at int")
    got = maintain.full_refresh(feed, f"file://{tmp_path}/v", "1", ["id"], ["at"], "category", {"id": 10})
    assert sorted((r.id, r.category) for r in got.collect()) == [(1, "b"), (2, "c")]


def test_places_over_a_whole_set(spark):
    rows = spark.range(1000).selectExpr("id", "pmod(hash(id), 37) as v").repartition(7)
    got = {r.id: r.place for r in topk.ranked(rows, [F.desc("v"), F.col("id")]).collect()}
    want = {r.id: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.v, r.id)), 1)}
    assert got == want and topk.ranked(rows.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("text,want", [("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&#38;lt;", "&lt;"), ("&#39;&#x2019;&#128512;", "'’😀"), ("&#0;&#55296;&#x110000;", "&#0;&#55296;&#x110000;"), ("&copy; &x; & a&b;", "&copy; &x; & a&b;"), ("no", "no"), ("", ""), (None, None), ("a\n&quot;b&nbsp;c", 'a\n"b c')])
def test_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.decode_entities(F.col("t")).alias("t")).first().t == want


def test_prices_as_text(spark):
    rows = spark.createDataFrame([(1234.5,), (999.4,), (0.0,), (float("nan"),), (None,), (1e7,)], "v double")
    assert [r.t for r in rows.select(scalars.price_text(F.col("v")).alias("t")).collect()] == ["Rs. 1,235", "Rs. 999", "Rs. 0", "", "", "Rs. 10,000,000"]
    assert rows.limit(1).select(scalars.price_text(F.col("v"), "USD").alias("t")).first().t == "USD 1,235"
