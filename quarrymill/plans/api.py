"""The catalog's requests as plans: listing, detail, taxonomy with facets, brands, search."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quarrymill.functions import literals
from quarrymill.functions.scalars import canonical_size, size_spellings
from quarrymill.operators import enrich, facets, postings, predicates, search, topk, tree
from quarrymill.operators.postings import Index

FEATURED_CAP = 10
#: Orders of the menu, and what the featured listing shows; fixed values.
GENDER_ORDER = ["Men", "Women", "Boys", "Girls", "Unisex"]
BRANCH_ORDER = ["Eastern", "Western", "Accessories", "Fragrance & Beauty"]
SUB_ORDERS = {"Eastern": ["Unstitched", "Semi-Stitched", "Stitched"], "Western": ["Upperwear", "Bottomwear", "Suits & Sets", "Formalwear", "Footwear"]}
FEATURED_GENDERS, FEATURED_BRANCHES = ["Men", "Women", "Unisex"], ["Western", "Eastern"]


@dataclass
class Catalog:
    """brands (id, slug, name), categories (id, parent_id, name), products, variants (with color), images."""

    brands: DataFrame
    categories: DataFrame
    products: DataFrame
    variants: DataFrame
    images: DataFrame


@dataclass
class Request:
    gender: str | None = None
    branch: str | None = None
    sub: str | None = None
    category: str | None = None
    categories: list[str] = field(default_factory=list)  # names to search for, at any level
    brand: str | None = None
    q: str | None = None
    on_sale: bool = False
    colors: list[str] = field(default_factory=list)
    sizes: list[str] = field(default_factory=list)
    min_price: object = None
    max_price: object = None
    out_of_stock: bool = False
    sort: str | None = None
    exclude: list[int] = field(default_factory=list)  # ids that the featured listing leaves out
    page: object = 1
    page_size: object = 24


def _visible(c: Catalog) -> DataFrame:
    return c.products.where("is_active and is_browsable")


def brand_id(c: Catalog, name: str | None):
    """Id of a brand by slug or name, whatever its case; None if there is none."""
    if not name:
        return None
    low = name.strip().lower()
    row = c.brands.where((F.lower("slug") == low) | (F.lower("name") == low)).agg(F.min("id")).first()
    return row[0]


def refine(c: Catalog, r: Request, fold_colors: bool = False, unresolved: str = "empty") -> DataFrame:
    """The products behind a request's filters; each test on variants is met by some variant, not by the same."""
    rows = _visible(c)
    levels = [r.gender, r.branch, r.sub, r.category]
    if any(levels):
        closed = tree.closure(c.categories)
        at = tree.resolve_path(c.categories, closed, levels)
        if at is None:
            return rows.where(F.lit(False))
        below = tree.descendants(closed, at).select(F.col("descendant_id").alias("category_id"))
        rows = rows.join(below, "category_id", "left_semi")
    if r.categories:
        roots = [r.gender] if r.gender else ["Men", "Women", "Unisex"]
        rows = rows.join(tree.resolve_names(c.categories, tree.closure(c.categories), roots, r.categories), "category_id", "left_semi")
    if r.brand:
        rows = predicates.resolved(rows, "brand_id", brand_id(c, r.brand), unresolved)
    if r.q:
        rows = rows.where(predicates.matches("title", r.q))
    v = c.variants
    if r.on_sale:
        rows = predicates.on_sale(rows, v, "id", "product_id", F.col("current_price"), F.col("current_compare_at"))
    if r.colors:
        rows = predicates.with_color(rows, v, "id", "product_id", "color", r.colors, fold_colors)
    if r.sizes:
        rows = predicates.with_size(rows, v, "id", "product_id", "size_label", size_spellings(r.sizes), F.col("current_available"))
    if not r.out_of_stock:
        rows = predicates.any_child(rows, v, "id", "product_id", F.col("current_available"))
    return predicates.cheapest_between(rows, v, "id", "product_id", "current_price", r.min_price, r.max_price)


def _cards(c: Catalog, ids: DataFrame) -> DataFrame:
    """The wide columns of a page; a product without variants vanishes from it, though totals count it."""
    near = c.variants.join(ids.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    best = enrich.cheapest_child(near, "product_id", "current_price", ["current_price", "current_compare_at"], ["id"], F.col("current_available"))
    image = enrich.first_child(c.images.join(ids.select(F.col("id").alias("product_id")), "product_id", "left_semi"), "product_id", "url", ["position"], name="image")
    rows = enrich.late_join(ids, c.products, "id").join(best.withColumnRenamed("product_id", "id"), "id").join(image.withColumnRenamed("product_id", "id"), "id", "left")
    named = rows.join(c.brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand")), "brand_id")
    shown = F.when(F.col("current_compare_at") > F.col("current_price"), F.col("current_compare_at"))
    return named.select(F.col("id").cast("string").alias("id"), "title", "brand", F.col("current_price").alias("price"), shown.alias("compare_at"), "any_available", "image", "place")


def shop_request(r: Request) -> Request:
    """The request that the shop's page sends: sizes count only where a leaf category is chosen."""
    return r if r.category else replace(r, sizes=[])


def list_products(c: Catalog, r: Request) -> tuple[int, DataFrame]:
    """(number of products behind the filters, the page with place from 0). No sort interleaves the brands.

    'featured' shows adult clothes without the excluded ids: each brand's newest, capped, brands in turn; its total is
    the number before the cap.
    """
    rows = refine(c, r)
    if r.sort == "featured":
        shown = tree.branches_of(tree.closure(c.categories), c.categories, FEATURED_GENDERS, FEATURED_BRANCHES)
        rows = rows.join(shown.select(F.col("id").alias("category_id")), "category_id", "left_semi")
        rows = rows.where(~F.col("id").isin(r.exclude)) if r.exclude else rows
    total = rows.count()
    offset, limit = topk.page_bounds(r.page, r.page_size)
    narrow = rows.select("id", "brand_id", "first_seen_at")
    newest = [F.desc("first_seen_at"), F.desc("id")]
    if r.sort in (None, "", "newest"):
        page = topk.interleave(narrow, "brand_id", newest, offset, limit)
        order = [F.col("rn"), F.col("brand_id")]
    elif r.sort == "featured":
        page = topk.featured(narrow, "brand_id", newest, FEATURED_CAP, offset, limit)
        order = [F.col("rn"), F.col("bp")]
    else:
        least = c.variants.groupBy(F.col("product_id").alias("id")).agg(F.min("current_price").alias("price"))
        order = topk.listing_order(r.sort, "price", "first_seen_at", "id")
        page = narrow.join(least, "id", "left").orderBy(*order).offset(offset).limit(limit)
    placed = page.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).select("id", "place")
    return total, _cards(c, placed).orderBy("place")


def product_detail(c: Catalog, product_id: int) -> DataFrame:
    """One row: the product with brand, path, cheapest price, images and variants in order, availability by colour and size, and for each colour its first image; none for a hidden or unknown id.

    ``variants`` of the catalog may have an image_url; without that column colours have no image.
    """
    one = _visible(c).where(F.col("id") == product_id)
    v, i = c.variants.where(F.col("product_id") == product_id), c.images.where(F.col("product_id") == product_id)
    v = v if "image_url" in v.columns else v.withColumn("image_url", F.lit(None).cast("string"))
    maps = enrich.availability_maps(v.where("color is not null and size_label is not null"), "product_id", "color", "size_label", F.col("current_available"))
    cards = enrich.color_cards(v, "product_id", "color", F.col("current_available"), F.col("image_url"), ["id"])
    best = enrich.cheapest_child(v, "product_id", "current_price", ["current_price", "current_compare_at"], ["id"], F.col("current_available"))
    rows = v.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("id", "color", "size_label", "current_price", "current_available"))).alias("variants"))
    pics = i.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]).alias("images"))
    path = tree.paths(tree.closure(c.categories), c.categories).select(F.col("id").alias("category_id"), "path")
    out = one.withColumn("product_id", F.col("id"))
    for side in (rows, pics, maps, cards, best):
        out = out.join(side, "product_id", "left")
    out = out.join(path, "category_id", "left").join(c.brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand")), "brand_id", "left")
    shown = F.when(F.col("current_compare_at") > F.col("current_price"), F.col("current_compare_at"))
    return out.select("id", "title", "brand", "path", F.col("current_price").alias("price"), shown.alias("compare_at"), "any_available", "variants", "images", "by_color", "cards")


def taxonomy(c: Catalog, r: Request) -> dict[str, DataFrame]:
    """The menu with counts, and the facets of the refined set: brands, sizes, colours, price bounds, total. An unknown brand is dropped."""
    rows = refine(c, r, unresolved="drop").select("id", "brand_id", "category_id")
    v = c.variants.where("current_available").join(rows.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    counts = facets.counts(rows, "category_id")
    return {
        "menu": tree.menu(tree.closure(c.categories), c.categories, counts, "category_id", "n", GENDER_ORDER, BRANCH_ORDER, SUB_ORDERS),
        "brands": facets.counts(rows, "brand_id").join(c.brands.select(F.col("id").alias("brand_id"), "name"), "brand_id").orderBy(F.desc("n"), "name"),
        "sizes": facets.merged_counts(v, "size_label", canonical_size(F.col("size_label")), "product_id", False, 16),
        "colors": facets.distinct_counts(v, "color", "product_id").orderBy(F.desc("n"), "color").limit(12),
        "price": facets.bounds(v, "current_price"),
        "total": rows.agg(F.count("*").alias("n")),
    }


def featured_categories(c: Catalog, items: str) -> DataFrame:
    """gender, category, count, image_url, place of the wanted cards, as in 'Men:Polo,Women:Shirt': the first node of that name below the gender, its own visible products in stock, and the first image of the first of these.

    A card whose gender or name isn't found, or whose category has no product, is left out; no card gives no rows.
    """
    wanted = [(g, n) for g, _, n in (x.partition(":") for x in items.split(",") if x)]
    if not wanted:
        return c.products.sparkSession.createDataFrame([], "gender string, category string, count long, image_url string, place long")
    cards = literals.values(c.products.sparkSession, wanted, ["gender", "category"]).withColumnRenamed("id", "place")
    roots = c.categories.where("parent_id is null").select(F.col("id").alias("root"), F.lower("name").alias("__root"))
    met = cards.join(roots, F.lower(F.trim("gender")) == F.col("__root")).drop("__root")
    found = tree.find_descendants(tree.closure(c.categories), c.categories, met, "root", "category").where("found is not null")
    shown = predicates.any_child(_visible(c), c.variants, "id", "product_id", F.col("current_available")).join(F.broadcast(found.select("found").distinct()), F.col("category_id") == F.col("found"), "left_semi").select("id", "category_id")
    image = enrich.first_child(c.images.join(shown.select(F.col("id").alias("product_id")), "product_id", "left_semi"), "product_id", "url", ["position"], name="image_url")
    # the first image in the order of products, so of the first product that has one
    per = shown.join(image.withColumnRenamed("product_id", "id"), "id", "left").groupBy("category_id").agg(F.count("*").alias("count"), F.min_by("image_url", F.when(F.col("image_url").isNotNull(), F.col("id"))).alias("image_url"))
    return found.join(per, F.col("found") == F.col("category_id")).select("gender", "category", "count", "image_url", "place").orderBy("place")


def brands(c: Catalog) -> DataFrame:
    """Every brand with its number of visible products, zero included."""
    return facets.counts_with_zeros(c.brands, "id", _visible(c), "brand_id").orderBy("name")


def _searched(c: Catalog, r: Request, override: str | None) -> DataFrame:
    """The candidates of a search: always in stock, colours whatever their case, an unknown brand is dropped; an override of the gender counts only if it is one of the known ones."""
    r = replace(r, gender=override) if override in GENDER_ORDER else r
    return refine(c, r, fold_colors=True, unresolved="drop").withColumn("searched", F.concat_ws(" ", "title", "description"))


def request_of(filters: Row) -> Request:
    """The search that a row of filters asks for (``understanding.filters``, or a valid struct from elsewhere)."""
    return Request(gender=filters["gender"], categories=list(filters["categories"] or []), brand=filters["brand"], on_sale=bool(filters["onSale"]), colors=list(filters["colors"] or []), sizes=list(filters["sizes"] or []), min_price=filters["minPrice"], max_price=filters["maxPrice"])


def search_index(c: Catalog, folder: str) -> Index:
    """The full-text index of the products' titles and descriptions, written to ``folder`` with each load and read by every search."""
    return postings.write_index(c.products.select("id", F.concat_ws(" ", "title", "description").alias("searched")), "id", "searched", folder)


def search_products(c: Catalog, r: Request, query_vector: list[float], residual: str, override: str | None = None, index: Index | None = None) -> DataFrame:
    """Hybrid search behind the hard filters: the answer's cards in order. With the index of title and description (``search_index``) the text leg is English full text."""
    found = search.hybrid(_searched(c, r, override), "id", "embedding", "searched", "category_id", "brand_id", query_vector, residual, index=index)
    return _cards(c, found.select("id", "place")).orderBy("place")


def search_debug(c: Catalog, r: Request, query_vector: list[float], residual: str, override: str | None = None, index: Index | None = None) -> DataFrame:
    """Both legs' ranks and the fused score of every row that either leg found, best first."""
    legs = search.both_legs(_searched(c, r, override), "id", "embedding", "searched", ["title"], "brand_id", query_vector, residual, index=index)
    return legs.withColumn("score", search.rrf()).orderBy(F.desc("score"), "id")


def search_log(answer: DataFrame, query: str, r: Request, category_found: bool, at: object) -> DataFrame | None:
    """The log's row for a search: at, query, gender, results, zero; None where the wanted category wasn't found, as such searches aren't logged."""
    if not category_found:
        return None
    return answer.agg(F.count("*").alias("results")).select(F.lit(at).alias("at"), F.lit(query).alias("query"), F.lit(r.gender).cast("string").alias("gender"), "results", (F.col("results") == 0).alias("zero"))
