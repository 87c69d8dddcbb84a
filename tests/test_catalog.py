"""Requests over a small catalog, feeds, streams and properties of the orders."""

import datetime as dt
import json
import math
import random
from collections import deque
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import maintain, topk, tree
from quarrymill.plans import api
from quarrymill.sources import stores
from quarrymill.streaming import live

D = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def cat(spark):
    brands = spark.createDataFrame([(1, "alpha", "Alpha"), (2, "beta", "Beta"), (3, "none", "None")], "id long, slug string, name string")
    nodes = [(1, None, "Men"), (2, None, "Women"), (3, 1, "Western"), (4, 3, "Upperwear"), (5, 4, "Shirt"), (6, 4, "Polo"), (7, 2, "Western"), (8, 7, "Upperwear"), (9, 8, "Shirt")]
    cats = spark.createDataFrame(nodes, "id long, parent_id long, name string")
    products = [(i, 1 + i % 2, f"Shirt {i}", "soft cotton" if i % 2 else "plain", 5 if i < 6 else 9, D + dt.timedelta(days=i), i != 3, True, [float(i), 1.0] if i != 4 else None) for i in range(1, 10)]
    prod = spark.createDataFrame(products, "id long, brand_id long, title string, description string, category_id long, first_seen_at timestamp, is_active boolean, is_browsable boolean, embedding array<float>")
    var = []
    for i in range(1, 9):  # product 9 has none
        var.append((10 * i, i, "Red", "M", 100.0 + i, 150.0 if i % 2 else None, True))
        var.append((10 * i + 1, i, "blue", "Large", None if i == 2 else 90.0 + i, None, i % 4 != 0))
    variants = spark.createDataFrame(var, "id long, product_id long, color string, size_label string, current_price double, current_compare_at double, current_available boolean")
    images = spark.createDataFrame([(i, k, f"u{i}-{k}") for i in range(1, 9) for k in (2, 1)], "product_id long, position int, url string")
    return api.Catalog(brands, cats, prod, variants, images)


def ids(df):
    return [int(r.id) for r in df.collect()]


def test_listing(cat):
    total, page = api.list_products(cat, api.Request())
    assert total == 7 and ids(page) == [8, 7, 6, 5, 4, 1, 2]  # brand 1 is even, brand 2 odd; 3 is gone, 9 has no variants
    total, page = api.list_products(cat, api.Request(out_of_stock=True, sort="x"))
    assert total == 8 and 9 not in ids(page)  # counted, but vanishes from the page
    assert ids(api.list_products(cat, api.Request(sort="price_asc", page_size="2"))[1]) == [1, 4]
    assert ids(api.list_products(cat, api.Request(sort="featured", page="2", page_size=3))[1]) == [5, 4, 1]
    assert api.list_products(cat, api.Request(brand="ALPHA"))[0] == 4 and api.list_products(cat, api.Request(brand="zzz"))[0] == 0


def test_filters(cat):
    n = lambda **k: api.list_products(cat, api.Request(**k))[0]
    assert n(gender="men") == 4 and n(gender="Women", category="shirt") == 3 and n(gender="Men", category="nothing") == 0
    assert n(colors=["red"]) == 0 and n(colors=["Red"]) == 7
    assert n(sizes=["L"]) == 5 and n(sizes=["L"], colors=["Red"]) == 5
    assert n(on_sale=True) == 3 and n(q="SHIRT 1") == 1 and n(min_price=95, max_price=96.5) == 2 and n(min_price="x") == 7
    assert n(min_price="95", max_price=" 96.5 ") == 2 and n(min_price="nan", max_price="inf") == 7 and n(min_price=True) == 7
    assert api.shop_request(api.Request(sizes=["L"])).sizes == [] and api.shop_request(api.Request(sizes=["L"], category="Shirt")).sizes == ["L"]


def test_detail_brands_taxonomy(cat):
    one = api.product_detail(cat, 1).first()
    assert one.path == "Men > Western > Upperwear > Shirt" and one.images == ["u1-1", "u1-2"] and one.by_color["Red"]["M"]
    assert one.brand == "Beta" and one.price == 91.0 and one.compare_at is None and one.any_available and one.cards["Red"].available and one.cards["Red"].image is None
    assert api.product_detail(cat, 3).count() == 0
    pictured = replace(cat, variants=cat.variants.withColumn("image_url", F.when(F.col("color") == "Red", F.concat(F.lit("p"), "id"))))
    assert api.product_detail(pictured, 1).first().cards["Red"].image == "p10"
    assert [(r.name, r.n) for r in api.brands(cat).collect()] == [("Alpha", 4), ("Beta", 4), ("None", 0)]
    t = api.taxonomy(cat, api.Request(brand="zzz"))
    assert t["total"].first().n == 7 and {r["name"]: r.total for r in t["menu"].collect()} == {"Men": 4, "Women": 3}
    assert [(r.size_label, r.n) for r in t["sizes"].collect()] == [("M", 7), ("L", 5)]


def test_search(cat):
    found = api.search_products(cat, api.Request(colors=["RED"], brand="zzz"), [0.0, 1.0], "a cotton thing").collect()
    assert sorted(int(r.id) for r in found) == [1, 2, 5, 6, 7, 8]  # 4 has no vector
    assert int(found[0].id) in (1, 5, 7)
    debug = {r.id: r for r in api.search_debug(cat, api.Request(colors=["RED"]), [0.0, 1.0], "a cotton thing").collect()}
    assert set(debug) == {1, 2, 5, 6, 7, 8} and debug[1].rank_t is not None and debug[2].rank_t is None and all(r.rank_v for r in debug.values())
    men = api.search_products(cat, api.Request(), [0.0, 1.0], "shirt", override="Men")
    assert {int(r.id) for r in men.collect()} == {1, 2, 5} and api.search_products(cat, api.Request(), [0.0, 1.0], "shirt", override="nobody").count() == 6
    row = api.search_log(men, "shirt", api.Request(gender="Men"), True, "2024-01-01").first()
    assert (row.results, row.zero, row.gender) == (3, False, "Men") and api.search_log(men, "x", api.Request(), False, "2024-01-01") is None


def test_featured_shows_adult_clothes_without_the_excluded(cat, spark):
    more = cat.categories.unionByName(spark.createDataFrame([(20, 1, "Accessories"), (21, 20, "Belt"), (30, None, "Boys"), (31, 30, "Western")], cat.categories.schema))
    moved = cat.products.withColumn("category_id", F.when(F.col("id") == 8, 21).when(F.col("id") == 7, 31).otherwise(F.col("category_id")))
    shop = replace(cat, categories=more, products=moved)
    assert api.list_products(shop, api.Request())[0] == 7
    total, page = api.list_products(shop, api.Request(sort="featured", exclude=[6]))
    assert total == 4 and ids(page) == [5, 4, 1, 2]


def test_menu_orders(spark):
    nodes = [(1, None, "Men"), (2, None, "Women"), (3, None, "Cargo"), (10, 1, "Western"), (11, 1, "Eastern"), (12, 1, "Accessories"), (20, 10, "Footwear"), (21, 10, "Upperwear"), (22, 10, "Other"), (30, 20, "Shoes"), (31, 21, "Polo"), (32, 21, "Shirt"), (33, 22, "Thing"), (40, 11, "Stitched"), (41, 40, "Kurta"), (50, 12, "Belt"), (51, 12, "Cap")]
    tree_ = spark.createDataFrame(nodes, "id long, parent_id long, name string")
    counts = spark.createDataFrame([(30, 5), (31, 1), (33, 2), (41, 3), (50, 9), (3, 4)], "k long, n long")
    got = {r["name"]: r for r in tree.menu(tree.closure(tree_), tree_, counts, "k", "n", api.GENDER_ORDER, api.BRANCH_ORDER, api.SUB_ORDERS).collect()}
    assert set(got) == {"Men"}  # Women has no rows, Cargo isn't in the order
    assert [(c["name"], c.total) for c in got["Men"]["columns"]] == [("Eastern", 3), ("Western", 8), ("Accessories", 9)]
    west, acc = got["Men"]["columns"][1], got["Men"]["columns"][2]
    assert [(x["name"], x.total, [y["name"] for y in x.leaves]) for x in west.subs] == [("Upperwear", 1, ["Polo"]), ("Footwear", 5, ["Shoes"]), ("Other", 2, ["Thing"])] and west.leaves is None
    assert acc.subs is None and [y["name"] for y in acc.leaves] == ["Belt"]
    free = tree.menu(tree.closure(tree_), tree_, counts, "k", "n").orderBy("place").collect()
    assert [r["name"] for r in free] == ["Men", "Cargo"] and [c["name"] for c in free[0]["columns"]] == ["Accessories", "Western", "Eastern"]
    menus = tree.menu(tree.closure(tree_), tree_, counts, "k", "n", api.GENDER_ORDER, api.BRANCH_ORDER, api.SUB_ORDERS)
    assert [r["name"] for r in tree.siblings(menus, "Men", "Western", "Polo").collect()] == ["Polo"]
    assert {r["name"] for r in tree.siblings(menus, "Men", "Western").collect()} == {"Polo", "Shoes", "Thing"}


def test_diversify_is_the_queues_order(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]), rng.random()) for i in range(30)]
        order = sorted(rows, key=lambda r: -r[3])
        cats: dict = {}
        for r in order:
            cats.setdefault(r[1] or "", {}).setdefault(r[2], deque()).append(r)

        def turns(buckets):
            buckets = [b for b in buckets]
            while buckets:
                for b in list(buckets):
                    yield b.popleft()
                    if not b:
                        buckets.remove(b)

        want = [r[0] for r in turns([deque(turns(list(brands.values()))) for brands in cats.values()])][:20]
        df = spark.createDataFrame(rows, "i int, c string, b string, s double")
        got = [r.i for r in topk.diversify(df, "c", "b", [F.desc("s")], 20).orderBy("place").collect()]
        assert got == want


def test_path_resolution(spark, cat):
    closed = tree.closure(cat.categories)
    assert tree.resolve_path(cat.categories, closed, ["Men", "Western", "Upperwear", "Polo"]) == 6
    assert tree.resolve_path(cat.categories, closed, ["Men", None, None, " polo "]) == 6
    assert tree.resolve_path(cat.categories, closed, ["Men", "Polo"]) is None
    assert tree.descendants(closed, None).count() == 9


def test_diff_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, 5.0, True), (2, 6.0, None)], "k int, p double, a boolean")
    new = spark.createDataFrame([(1, 5.5, True), (3, 1.0, True)], "k int, p double, a boolean")
    assert {(r.k, r.outcome) for r in maintain.outcomes(old, new, ["k"], ["p", "a"]).collect()} == {(1, "updated"), (2, "vanished"), (3, "new")}
    assert maintain.snapshots(new, new, ["k"], ["p", "a"], F.lit(1)).count() == 0
    assert [r.k for r in maintain.snapshots(old, new, ["k"], ["p", "a"], F.lit(1)).collect()] == [1]
    assert {r.outcome for r in maintain.outcomes(old, old, ["k"], ["p", "a"]).collect()} == {"unchanged"}


def test_canary(spark):
    runs = [("a", 1, 100, "completed"), ("a", 2, 69, "failed"), ("a", 3, 70, "completed"), ("b", 1, 100, "completed"), ("b", 2, 0, "completed"), ("c", 1, 100, "completed"), ("c", 2, 69, "completed")]
    df = spark.createDataFrame(runs, "store string, day int, fetched long, status string")
    assert {(r.store, r.day) for r in maintain.canary(df, "store", "day", "fetched").where("alert").collect()} == {("a", 2), ("c", 2)}


def test_featured_categories(cat):
    got = api.featured_categories(cat, "Women: shirt,Nobody:Shirt,,men:SHIRT,Men:Polo,Men,Men:no").collect()
    want = {5: [i for i in range(1, 9) if i < 6 and i != 3], 9: [i for i in range(6, 9)]}
    assert [(r.gender, r.category, r["count"], r.image_url) for r in got] == [("Women", " shirt", len(want[9]), "u6-1"), ("men", "SHIRT", len(want[5]), "u1-1")]
    assert api.featured_categories(cat, "").count() == 0


def test_search_by_a_query_alone(spark, cat, tmp_path):
    """The query's filters become the request, what is left the residual; with the index the text leg is full text."""
    from quarrymill.functions import understanding

    known = understanding.phrases(spark, cat.brands.select("name"))
    row = understanding.filters(spark.createDataFrame([(1, "soft cottons for men by Beta under 105")], "i int, q string"), "i", "q", known).first()
    r = api.request_of(row)
    assert (r.gender, r.brand, r.max_price, row.semantic_query) == ("Men", "Beta", 105.0, "soft cottons")
    index = api.search_index(cat, f"file://{tmp_path}/index")
    found = api.search_products(cat, r, [0.0, 1.0], row.semantic_query, index=index)
    assert {int(x.id) for x in found.collect()} == {1, 5}
    debug = {x.id: x.rank_t for x in api.search_debug(cat, api.Request(), [0.0, 1.0], "cottons", index=index).collect()}
    assert {i for i, t in debug.items() if t} == {1, 5, 7}


def test_alert_messages(spark):
    runs = spark.createDataFrame([("a", 100, 60, "completed", True), ("a", 100, 90, "completed", False), ("b", None, 0, "failed", False)], "store string, prior int, fetched int, status string, alert boolean")
    assert sorted(r.message for r in maintain.alert_messages(runs, "store", "fetched").collect()) == ["a: fetched 60 of 100 before", "b: run failed"]


def test_limiter(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), D + dt.timedelta(seconds=rng.randrange(200_000))) for i in range(400)]
    rows += [(1000 + i, "c", D + dt.timedelta(seconds=i)) for i in range(15)]
    df = spark.createDataFrame(rows, "i int, k string, ts timestamp")
    got = {r.i: r.allowed for r in live.limit_rate(df, "k", "ts", "i").collect()}
    past: dict = {}
    for i, k, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        hits = [h for h in past.get(k, []) if (ts - h).total_seconds() < 86_400]
        ok = len(hits) < 30 and sum((ts - h).total_seconds() < 60 for h in hits) < 10
        past[k] = hits + [ts] * ok
        assert got[i] == ok
    assert sum(got[1000 + i] for i in range(15)) == 10


def test_streams(spark, tmp_path):
    rows = [(i, "ab"[i % 2], D + dt.timedelta(minutes=i)) for i in range(40)] + [(0, "a", D)]
    spark.createDataFrame(rows, "i int, k string, ts timestamp").repartition(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("i int, k string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(run(live.dedupe_stream(read(), ["i"], "ts"), "deduped")) == 40
    buckets = run(live.bucketed_stream(read(), "ts", "15 minutes", "0 seconds", F.count("*").alias("n")), "buckets")
    assert {r.n for r in buckets} == {16, 15}
    limited = run(live.limit_rate_stream(read(), "k", "ts", 1, 5), "limited")
    assert sum(r.allowed for r in limited if r.k == "a") == 5


def test_limiter_sorts_all_chunks_of_a_trigger(spark, tmp_path):
    """A key's rows of one trigger come in many small chunks and in no order; the limit is that of their order in time."""
    rng = random.Random(6)
    times = [rng.randrange(3 * 86_400) for _ in range(300)]
    spark.createDataFrame([("a", D + dt.timedelta(seconds=t)) for t in times], "k string, ts timestamp").repartition(5).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = live.limit_rate_stream(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), "k", "ts", 2, 20)
        q = df.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hits: deque = deque()
    assert sum(r.allowed for r in spark.table("chunks").collect()) == sum(live.admit(hits, t, 2, 20) for t in sorted(times))


def test_changes_to_history_go_from_version_to_version(spark, tmp_path):
    """Each batch meets the state that the one before left; new keys enter; a batch that runs again gives the same."""
    state, history = str(tmp_path / "state"), str(tmp_path / "history")
    schema = "k int, p double, at timestamp"
    spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, p double").write.parquet(f"{state}/version=0")
    batches = [[(1, 5.5, D), (1, 5.7, D + dt.timedelta(hours=1)), (3, 1.0, D)], [(1, 5.7, D + dt.timedelta(hours=2)), (3, 2.0, D + dt.timedelta(hours=2))], [(2, 7.0, D + dt.timedelta(hours=3))]]
    for i, rows in enumerate(batches):
        for _ in range(2 if i == 1 else 1):
            live.changes_to_history(spark.createDataFrame(rows, schema), i, state, history, ["k"], ["p"], "at")
    told = sorted((r.k, r.p, r.observed_at) for r in spark.read.parquet(history).collect())
    assert told == [(1, 5.7, D + dt.timedelta(hours=1)), (2, 7.0, D + dt.timedelta(hours=3)), (3, 2.0, D + dt.timedelta(hours=2))]
    assert sorted((r.k, r.p) for r in live.latest_state(spark, state, 99).collect()) == [(1, 5.7), (2, 7.0), (3, 2.0)]


def test_first_spelling_stands(spark):
    old = spark.createDataFrame([(7, "Blue")], "id long, name string")
    names = spark.createDataFrame([(3, "RED"), (1, "Red "), (2, " blue"), (4, "Teal"), (0, None), (5, "teal")], "at int, name string")
    got = maintain.assign_ids(old, names, "name", F.lower(F.trim("name")), ["at"]).collect()
    assert sorted((r.id, r.name) for r in got) == [(8, "Red"), (9, "Teal")]


def test_full_refresh_is_a_version_of_its_own(spark, tmp_path):
    folder = str(tmp_path / "catalog")
    feed = spark.createDataFrame([(1, "a", 5, 2), (1, "b", 6, 1), (2, "c", 7, 3)], "k int, t string, p int, at int")
    got = maintain.full_refresh(feed, folder, "1", ["k"], ["at"], "p")
    assert sorted((r.k, r.t, r.p) for r in got.collect()) == [(1, "b", 6), (2, "c", 7)]
    again = maintain.full_refresh(feed.where("k = 2"), folder, "2", ["k"], ["at"], "p")
    assert again.count() == 1 and got.count() == 2  # the version before stays as it was
    assert maintain.full_refresh(feed.where("k = 9"), folder, "3", ["k"], ["at"], "p").count() == 0


def test_email_and_size_rules(spark):
    from quarrymill.functions import scalars

    cases = {"a@b.c": True, " a@b.c ": True, "a@b.": False, "a@.b": False, "a@.b.c": True, "a@b": False, "@b.c": False, "a@b@c.d": False, "a b@c.d": False, "": False, None: False, "a@..": False, "a@...": True, "x" * 250 + "@b.c": True, "x" * 251 + "@b.c": False}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", scalars.valid_email(F.col("a")).alias("ok")).collect()
    assert {r.a: r.ok for r in rows} == cases
    sizes = {"2-3Y": "kids_age_years", "12y": "kids_age_years", "50 ML": "volume_ml", "32": "waist_inches", " OS ": "one_size", "-": "one_size", "M": "alpha", "": "none", None: "none", "5-6": "alpha"}
    rows = spark.createDataFrame([(k,) for k in sizes], "a string").select("a", scalars.size_system(F.col("a")).alias("s")).collect()
    assert {r.a: r.s for r in rows} == sizes


def test_bm25_with_stems_and_null_texts(spark):
    from quarrymill.operators import search

    rows = spark.createDataFrame([(1, "walking dogs"), (2, "a walked dog dog"), (3, None), (4, "cats")], "i int, t string")
    plain = {r.i: r.text_score for r in search.text_leg(rows, "t", "i", ["dog"], bm25=True).collect()}
    assert set(plain) == {2}
    stemmed = search.text_leg(rows, "t", "i", ["walks", "dog"], bm25=True, stemmed=True).orderBy("rank_t").collect()
    assert [r.i for r in stemmed] == [1, 2]
    idf = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5))
    want = sum(idf(2) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * 4 / (7 / 4))) for f in (1, 2))
    assert abs(stemmed[1].text_score - want) < 1e-9 and stemmed[1].t == "a walked dog dog"


def test_feeds(spark, tmp_path):
    rest = {"id": 1, "title": "T", "handle": "t", "vendor": "V", "product_type": "P", "body_html": "<p>a  b</p>", "tags": "x, Cart-Hide", "options": [{"name": "Color", "values": ["Red"]}, {"name": "Size", "values": ["2-3Y"]}], "variants": [{"id": 7, "price": "10.00", "compare_at_price": "12.00", "available": True, "option1": "Red", "option2": "2-3Y"}, {"id": 8, "price": "bad", "compare_at_price": "0.00", "available": False, "option1": "Red", "option2": "M"}], "images": [{"src": "a", "variant_ids": [7]}, {"src": "b", "variant_ids": [7]}]}
    gql = {"id": "g1", "title": "G", "handle": "g", "productType": "P", "vendor": "V", "descriptionHtml": "<b>x</b>", "tags": ["t"], "priceRange": {"minVariantPrice": {"amount": "5.5"}}, "images": {"edges": [{"node": {"url": "i"}}]}, "variants": {"edges": [{"node": {"id": "v", "availableForSale": True}}]}}
    (tmp_path / "one.jsonl").write_text(json.dumps(rest) + "\n\n")
    (tmp_path / "two.jsonl").write_text(json.dumps(gql) + "\n")
    lines = stores.read_lines(spark, str(tmp_path))
    assert lines.count() == 2
    a = stores.normalize_rest(lines.where("store = 'one'")).first()
    assert (a.description, a.tags, float(a.price), float(a.compare_at), a.available, a.n_variants, a.images) == ("a b", ["x", "Cart-Hide"], 10.0, 12.0, False, 2, ["a", "b"])
    b = stores.normalize_graphql(lines.where("store = 'two'")).first()
    assert (b.native_id, float(b.price), b.compare_at, b.available, b.images) == ("g1", 5.5, None, True, ["i"])
    v = {r.variant_id: r for r in stores.variants_of(lines.where("store = 'one'")).collect()}
    assert {r.variant_id: r.image for r in stores.variants_of(lines.where("store = 'one'"), first_image=True).collect()}[7] == "a"
    assert v[7].color == "Red" and v[7].size_system == "kids_age_years" and v[7].image == "b" and not v[7].available and v[8].price is None


def test_paged_reading(spark):
    assert list(stores.rest_pages(lambda p: {1: [1, 2], 2: [3]}.get(p, []), 2)) == [1, 2, 3]
    page = lambda n, more: {"data": {"products": {"edges": [{"node": n}], "pageInfo": {"hasNextPage": more, "endCursor": n}}}}
    assert list(stores.graphql_pages(lambda c: page(1, True) if c is None else page(2, False))) == [1, 2]
    with pytest.raises(RuntimeError):
        list(stores.graphql_pages(lambda c: {"errors": ["no"]}))
    waits, answers = [], iter([(429, {"Retry-After": "999"}, None), (503, {}, None), (200, {}, "ok")])
    assert stores.with_retries(lambda: next(answers), sleep=waits.append) == "ok" and waits == [300.0, 2.0]
    with pytest.raises(RuntimeError):
        stores.with_retries(lambda: (404, {}, None), sleep=waits.append)
    now, slept = [0.0], []
    call = stores.paced(lambda p: p, 3.0, clock=lambda: now[0], sleep=lambda x: (slept.append(x), now.__setitem__(0, now[0] + x)))
    assert [call(1), call(2)] == [1, 2] and slept == [3.0]
    now[0] += 10
    assert call(3) == 3 and slept == [3.0]  # one pause a request, none if time has passed
    pages = {1: list(range(250)), 2: [250]}
    assert len(list(stores.rest_pages(stores.paced(pages.get, 3.0, clock=lambda: now[0], sleep=slept.append), 250))) == 251 and slept == [3.0, 3.0]
    with pytest.raises(RuntimeError):
        stores.with_token(lambda token, cursor: {}, None)
    assert stores.with_token(lambda token, cursor: {"t": token, "c": cursor}, "x")("y") == {"t": "x", "c": "y"}
    spark.dataSource.register(stores.store_source(lambda name: ({"id": i, "of": name} for i in range(3))))
    rows = spark.read.format("stores").option("stores", "a,b").load().collect()
    assert len(rows) == 6 and {r.store for r in rows} == {"a", "b"}
