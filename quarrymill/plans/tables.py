"""The star tables as the catalog's roles: part is the product, lineitem its variant, p_brand the brand, a region-nation-supplier tree the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANT_KEY = ["l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, name: regions from 1, nations from 100, suppliers from 1000."""
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("id"), (F.col("s_nationkey") + 100).cast("long").alias("parent_id"), F.col("s_name").alias("name"))
    return region.unionByName(nation).unionByName(supplier)


NODES_SQL = """nodes as (
  select (r_regionkey + 1)::bigint as id, null::bigint as parent_id, r_name as name from region
  union all select (n_nationkey + 100)::bigint, (n_regionkey + 1)::bigint, n_name from nation
  union all select (s_suppkey + 1000)::bigint, (s_nationkey + 100)::bigint, s_name from supplier)"""
CLOSURE_SQL = NODES_SQL + """,
closed as (
  select id as ancestor_id, id as descendant_id, 0 as depth, [-id] as path_ids, name as path from nodes
  union all
  select u.ancestor_id, n.id, u.depth + 1, list_append(u.path_ids, -n.id), u.path || ' > ' || n.name from closed u join nodes n on n.parent_id = u.descendant_id)"""
