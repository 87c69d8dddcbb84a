"""Product feeds of stores: JSON lines in two shapes, and a paged reader as a Python data source.

Both shapes become one: store, native_id, title, handle, vendor, product_type, description, tags, price, compare_at,
available, n_variants, images, sizes (the variants' values of the size option), variants (``VARIANTS``), raw. A tag that
takes a product off sale makes all its variants, and so the product, unavailable.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

REST = (
    "id long, title string, handle string, vendor string, product_type string, body_html string, tags string, options array<struct<name:string,values:array<string>>>,"
    "variants array<struct<id:long,sku:string,price:string,compare_at_price:string,available:boolean,option1:string,option2:string,option3:string,featured_image:struct<src:string>>>,"
    "images array<struct<src:string,variant_ids:array<long>>>"
)
_NODE = "array<struct<node:struct<{}>>>"
GRAPHQL = (
    "id string, title string, handle string, productType string, vendor string, descriptionHtml string, tags array<string>, priceRange struct<minVariantPrice:struct<amount:string,currencyCode:string>>,"
    f"images struct<edges:{_NODE.format('url:string,altText:string')}>,"
    f"variants struct<edges:{_NODE.format('id:string,title:string,sku:string,availableForSale:boolean,price:struct<amount:string>,selectedOptions:array<struct<name:string,value:string>>')}>"
)
MOST_IMAGES = 12
VARIANTS = "array<struct<variant_id:string,sku:string,price:decimal(10,2),compare_at:decimal(10,2),available:boolean,color:string,size:string,size_system:string,image:string>>"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """store (the file's name) and raw (a line) of all JSON-lines files in a folder; blank lines are skipped. Spark lists the folder, so absent files don't matter."""
    lines = spark.read.text(f"{folder}/*.jsonl").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("store"), F.col("value").alias("raw"))
    return lines.where(F.trim("raw") != "")


def _least(prices: Column) -> Column:
    return F.array_min(F.filter(F.transform(prices, lambda p: p.try_cast("decimal(10,2)")), lambda p: p.isNotNull()))


def _rest_tags() -> Column:
    """Tags come as text or as an array; either becomes an array."""
    from quarrymill.functions.scalars import parse_tags

    return F.coalesce(F.from_json("p.tags", "array<string>"), parse_tags(F.coalesce(F.col("p.tags"), F.lit(""))))


def _rest_variants(first_image: bool = False) -> Column:
    """The variants of the first shape: colour and size from the options whose names say so, the image that names the variant (the last one, or the first), else its own."""
    from quarrymill.functions.scalars import clean_compare_at, forced_unavailable, option_value, size_system

    names = F.transform(F.coalesce("p.options", F.array()), lambda o: o["name"])
    out_of = forced_unavailable(_rest_tags())

    def one(v: Column) -> Column:
        values = F.slice(F.array(v["option1"], v["option2"], v["option3"]), F.lit(1), F.greatest(F.size(names), F.lit(0)))
        own = F.try_element_at(F.filter(F.coalesce("p.images", F.array()), lambda i: F.array_contains(i["variant_ids"], v["id"])), F.lit(1 if first_image else -1))["src"]
        size = option_value(names, values, "size")
        return F.struct(
            v["id"].cast("string").alias("variant_id"), v["sku"].alias("sku"), v["price"].try_cast("decimal(10,2)").alias("price"), clean_compare_at(v["compare_at_price"], v["price"]).try_cast("decimal(10,2)").alias("compare_at"),
            (F.coalesce(v["available"], F.lit(False)) & ~out_of).alias("available"), option_value(names, values, "color").alias("color"), size.alias("size"), size_system(size).alias("size_system"), F.coalesce(own, v["featured_image"]["src"]).alias("image"),
        )

    return F.transform(F.coalesce("p.variants", F.array()), one).cast(VARIANTS)


def _rest_sizes() -> Column:
    """The variants' values of the first option whose name says size; none without such an option."""
    at = F.coalesce(F.array_position(F.transform(F.coalesce("p.options", F.array()), lambda o: F.lower(F.coalesce(o["name"], F.lit(""))).contains("size")), True), F.lit(0))
    value = lambda v: F.when(at == 1, v["option1"]).when(at == 2, v["option2"]).when(at == 3, v["option3"])
    return F.filter(F.transform(F.coalesce("p.variants", F.array()), value), lambda x: x.isNotNull())


def normalize_rest(lines: DataFrame) -> DataFrame:
    """The first shape."""
    from quarrymill.functions.scalars import clean_compare_at, strip_html

    rows = lines.withColumn("p", F.from_json("raw", REST)).withColumn("v", _rest_variants())
    first = F.try_element_at(F.array_sort(F.filter(F.transform("p.variants", lambda v: F.struct(v["price"].try_cast("decimal(10,2)").alias("a"), clean_compare_at(v["compare_at_price"], v["price"]).try_cast("decimal(10,2)").alias("b"))), lambda x: x["a"].isNotNull())), F.lit(1))
    return rows.select(
        "store", F.col("p.id").cast("string").alias("native_id"), "p.title", "p.handle", "p.vendor", F.col("p.product_type").alias("product_type"), strip_html(F.col("p.body_html")).alias("description"),
        _rest_tags().alias("tags"), _least(F.transform("p.variants", lambda v: v["price"])).alias("price"), first["b"].alias("compare_at"), F.exists("v", lambda v: v["available"]).alias("available"),
        F.size("v").alias("n_variants"), F.slice(F.transform("p.images", lambda i: i["src"]), 1, MOST_IMAGES).alias("images"), _rest_sizes().alias("sizes"), F.col("v").alias("variants"), "raw",
    )


def normalize_graphql(lines: DataFrame) -> DataFrame:
    """The second shape; it never has a compare-at price, nor images of variants."""
    from quarrymill.functions.scalars import forced_unavailable, option_value, size_system, strip_html

    tags = F.coalesce("p.tags", F.array().cast("array<string>"))
    out_of = forced_unavailable(tags)

    def one(e: Column) -> Column:
        n = e["node"]
        options = F.coalesce(n["selectedOptions"], F.array())
        names, values = F.transform(options, lambda o: o["name"]), F.transform(options, lambda o: o["value"])
        size = option_value(names, values, "size")
        return F.struct(
            n["id"].alias("variant_id"), n["sku"].alias("sku"), n["price"]["amount"].try_cast("decimal(10,2)").alias("price"), F.lit(None).cast("decimal(10,2)").alias("compare_at"),
            (F.coalesce(n["availableForSale"], F.lit(False)) & ~out_of).alias("available"), option_value(names, values, "color").alias("color"), size.alias("size"), size_system(size).alias("size_system"), F.lit(None).cast("string").alias("image"),
        )

    edges = F.coalesce("p.variants.edges", F.array())
    rows = lines.withColumn("p", F.from_json("raw", GRAPHQL)).withColumn("v", F.transform(edges, one).cast(VARIANTS))
    named = F.flatten(F.transform(edges, lambda e: F.coalesce(e["node"]["selectedOptions"], F.array())))
    sizes = F.transform(F.filter(named, lambda o: (F.lower(o["name"]) == "size") & o["value"].isNotNull()), lambda o: o["value"])
    return rows.select(
        "store", F.col("p.id").alias("native_id"), "p.title", "p.handle", "p.vendor", F.col("p.productType").alias("product_type"), strip_html(F.col("p.descriptionHtml")).alias("description"),
        tags.alias("tags"), F.col("p.priceRange.minVariantPrice.amount").try_cast("decimal(10,2)").alias("price"), F.lit(None).cast("decimal(10,2)").alias("compare_at"),
        F.exists("v", lambda v: v["available"]).alias("available"), F.size("v").alias("n_variants"),
        F.slice(F.transform("p.images.edges", lambda e: e["node"]["url"]), 1, MOST_IMAGES).alias("images"), sizes.alias("sizes"), F.col("v").alias("variants"), "raw",
    )


def variants_of(lines: DataFrame, first_image: bool = False) -> DataFrame:
    """A row a variant of the first shape: store, native_id and the fields of ``VARIANTS``, the variant's id as a number."""
    rows = lines.withColumn("p", F.from_json("raw", REST))
    out = rows.select("store", F.col("p.id").cast("string").alias("native_id"), F.explode(_rest_variants(first_image)).alias("v"))
    return out.select("store", "native_id", F.col("v.variant_id").cast("long").alias("variant_id"), "v.price", "v.compare_at", "v.available", "v.color", "v.size", "v.size_system", "v.image")


def new_variant_images(variants: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """``key``, image of the variants whose image, as a backfill takes it, differs from the one they have: what is to be written."""
    fresh = variants_of(lines, first_image=True).where("image is not null").select(*key, F.col("image").alias("fresh"))
    met = variants.select(*key, "image").join(fresh, key)
    return met.where(~F.col("image").eqNullSafe(F.col("fresh"))).select(*key, F.col("fresh").alias("image"))


# Paged reading


def with_retries(call: Callable[[], tuple[int, dict, object]], most: int = 4, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """The body of a call that gives (status, headers, body): 429 waits as told (300 s at most) or backs off, 5xx and dropped connections back off, other errors raise."""
    for n in range(1, most + 1):
        wait = base * 2 ** (n - 1)
        try:
            status, headers, body = call()
        except (ConnectionError, TimeoutError):
            if n == most:
                raise
            sleep(wait)
            continue
        if status < 400:
            return body
        if n == most or (status != 429 and status < 500):
            raise RuntimeError(f"status {status}")
        sleep(min(300.0, float(headers["Retry-After"])) if status == 429 and str(headers.get("Retry-After", "")).isdigit() else wait)
    raise RuntimeError("no call was made")


def rest_pages(fetch: Callable[[int], list], size: int = 250) -> Iterator[object]:
    """Items of numbered pages until one is empty or short."""
    page = 1
    while items := fetch(page):
        yield from items
        if len(items) < size:
            return
        page += 1


def graphql_pages(fetch: Callable[[str | None], dict]) -> Iterator[object]:
    """Nodes of cursor pages; an answer with errors fails the store."""
    cursor = None
    while True:
        body = fetch(cursor)
        if body.get("errors"):
            raise RuntimeError(str(body["errors"])[:200])
        found = body["data"]["products"]
        yield from (edge["node"] for edge in found["edges"])
        if not found["pageInfo"]["hasNextPage"]:
            return
        cursor = found["pageInfo"]["endCursor"]


def paced(call: Callable, pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` with at least ``pause`` seconds from one request to the next, whatever a request brings."""
    last: list[float] = []

    def waiting(*args, **kwargs):
        if last and (rest := pause - (clock() - last[0])) > 0:
            sleep(rest)
        last[:] = [clock()]
        return call(*args, **kwargs)

    return waiting


def with_token(fetch: Callable[[str, str | None], dict], token: str | None) -> Callable[[str | None], dict]:
    """A cursor page's call that bears the store's token; a store without one fails at once, before any request."""
    if not token:
        raise RuntimeError("the store has no token")
    return lambda cursor: fetch(token, cursor)


class _Store(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class _Reader(DataSourceReader):
    def __init__(self, stores: list[str], read: Callable[[str], Iterator[dict]]):
        self.stores, self.read_store = stores, read

    def partitions(self) -> list[InputPartition]:
        return [_Store(x) for x in self.stores]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        for item in self.read_store(partition.value):
            yield partition.value, json.dumps(item)


def store_source(read: Callable[[str], Iterator[dict]]) -> type[DataSource]:
    """A data source 'stores' with one partition a store (option ``stores``, comma-separated); ``read`` gives a store's products.

    A store's requests are spaced by ``paced`` around its page call, so a page of many products waits once.
    """

    class Stores(DataSource):
        @classmethod
        def name(cls) -> str:
            return "stores"

        def schema(self) -> str:
            return "store string, raw string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader([x for x in self.options.get("stores", "").split(",") if x], read)

    return Stores
