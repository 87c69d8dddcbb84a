"""A daily run over two stores, one of which fails; searches by category names; filling of vectors."""

from pyspark.sql import functions as F

from quarrymill.operators import search, tree
from quarrymill.plans import ingest

FEED = "store string, native_id string, title string, handle string, vendor string, product_type string, description string, tags array<string>, price double, compare_at double, available boolean"


def feed(spark, rows):
    return spark.createDataFrame([(s, i, t, "h", v, "", "", [], p, None, a) for s, i, t, v, p, a in rows], FEED)


def test_daily(spark):
    leaves = spark.createDataFrame([("Men", "Western", "Upperwear", "Polo", 6), ("Men", "Western", None, None, 3), ("Men", None, None, None, 1), ("Unisex", None, None, None, 9)], "gender string, branch string, sub string, leaf string, category_id int")
    runs = lambda at, b: spark.createDataFrame([("a", at, "completed"), ("b", at, b)], "store string, started_at string, status string")
    empty = spark.createDataFrame([], "store string, native_id string, title string, description string, category_id int, price double, compare_at double, available boolean, first_seen string, last_seen string, is_active boolean")
    one = feed(spark, [("a", "1", "Polo", "Men", 5.0, True), ("a", "2", "Hoodie", "Men", 6.0, True), ("a", "3", "Gift Card", "", 7.0, True), ("b", "1", "Polo", "Boys", 8.0, True)])
    first = ingest.daily(empty, one, leaves, runs("2024-01-01", "completed"), F.lit("2024-01-01"))
    state = first.state.cache()
    assert {(r.store, r.native_id): r.category_id for r in state.collect()} == {("a", "1"): 6, ("a", "2"): 3, ("b", "1"): None}
    assert first.excluded.count() == 1 and first.history.count() == 0 and {r.outcome for r in first.outcomes.collect()} == {"new"}

    again = ingest.daily(state, one, leaves, runs("2024-01-02", "completed"), F.lit("2024-01-02"))
    assert {r.outcome for r in again.outcomes.collect()} == {"unchanged"} and again.history.count() == 0
    assert ingest.reclassified(one, state, leaves).count() == 0

    two = feed(spark, [("a", "1", "Polo", "Men", 4.0, True)])
    then = ingest.daily(state, two, leaves, runs("2024-01-03", "failed"), F.lit("2024-01-03"))
    active = {(r.store, r.native_id): r.is_active for r in then.state.collect()}
    assert active == {("a", "1"): True, ("a", "2"): False, ("b", "1"): True}  # the failed store delists nothing
    assert [(r.native_id, r.price) for r in then.history.collect()] == [("1", 4.0)]
    assert {(r.store, r.products_updated, r.products_removed) for r in then.counters.collect()} == {("a", 1, 1)}


def test_runs_of_a_tier_or_a_store(spark):
    leaves = spark.createDataFrame([("Men", "Western", "Upperwear", "Polo", 6)], "gender string, branch string, sub string, leaf string, category_id int")
    runs = spark.createDataFrame([("a", "2024-01-01", "completed"), ("b", "2024-01-01", "completed"), ("c", "2024-01-01", "failed")], "store string, started_at string, status string")
    empty = spark.createDataFrame([], "store string, native_id string, title string, description string, category_id int, price double, compare_at double, available boolean, first_seen string, last_seen string, is_active boolean")
    one = feed(spark, [("a", "1", "Polo", "Men", 5.0, True), ("a", "3", "Gift Card", "", 7.0, True), ("b", "1", "Polo", "Boys", 8.0, True)])
    dry = ingest.run("daily", empty, one, leaves, runs, F.lit("2024-01-01"), dry_run=True)
    assert dry.state.count() == 0
    counted = {r.store: r.asDict() for r in dry.counters.collect()}
    assert counted["a"] == {"store": "a", "products_new": 1, "products_updated": 0, "products_unchanged": 0, "products_removed": 0, "excluded": 1, "errors": 0, "variants": 2, "snapshots": 0}
    assert counted["c"]["errors"] == 1 and counted["c"]["products_new"] == 0
    state = ingest.run("daily", empty, one, leaves, runs, F.lit("2024-01-01")).state.cache()
    assert state.count() == 2
    two = feed(spark, [("a", "1", "Polo", "Men", 4.0, True), ("b", "1", "Polo", "Boys", 9.0, False), ("b", "2", "Polo", "Boys", 9.0, True)])
    just_a = ingest.run("daily", state, two, leaves, runs, F.lit("2024-01-02"), store="a")
    assert {(r.store, r.native_id): r.price for r in just_a.state.collect()} == {("a", "1"): 4.0, ("b", "1"): 8.0}
    hourly = ingest.run("hourly", state, two, leaves, runs, F.lit("2024-01-02"))
    assert {(r.store, r.native_id): (r.price, r.available) for r in hourly.state.collect()} == {("a", "1"): (4.0, True), ("b", "1"): (9.0, False)}
    assert [(r.store, r.native_id) for r in hourly.excluded.collect()] == [("b", "2")]  # asked for, not found
    assert {(r.store, r.status) for r in ingest.status(runs).collect()} == {("a", "completed"), ("b", "completed"), ("c", "failed")}


def test_names_are_resolved_under_each_root(spark):
    nodes = spark.createDataFrame([(1, None, "Men"), (2, None, "Women"), (3, 1, "Western"), (4, 3, "Shirt"), (5, 3, "Polo"), (7, 2, "Western"), (8, 7, "Shirt")], "id long, parent_id long, name string")
    closed = tree.closure(nodes)
    ids = lambda roots, names: {r.category_id for r in tree.resolve_names(nodes, closed, roots, names).collect()}
    assert ids(["Men", "Women"], ["shirt"]) == {4, 8} and ids(["Men"], ["Western", "Shirt"]) == {4}  # the ancestor is pruned
    assert ids(["Women"], []) == {2, 7, 8} and ids(["Men"], ["nothing"]) == set()


def test_missing_vectors_are_filled(spark):
    df = spark.createDataFrame([(i, f"t{i}", None if i % 2 else [1.0]) for i in range(7)], "id long, text string, v array<float>")
    got = {r.id: r.v for r in search.fill_embeddings(df, "id", "text", "v", lambda texts: [[float(len(t))] for t in texts], 2).collect()}
    assert got == {1: [2.0], 3: [2.0], 5: [2.0]}


RAW = """{"id": 1, "title": "Plain Dress", "vendor": "", "product_type": "", "tags": "%s", "options": [{"name": "Color"}, {"name": "Shoe Size"}], "variants": [%s], "images": [{"src": "a", "variant_ids": [11, 12]}, {"src": "b", "variant_ids": [11]}]}"""
VARIANT = '{"id": %d, "sku": "s%d", "price": "%s", "compare_at_price": "0.00", "available": %s, "option1": "Red", "option2": "%s"}'


def rest_lines(spark, variants, tags="", store="a"):
    raw = RAW % (tags, ", ".join(VARIANT % (i, i, p, str(ok).lower(), size) for i, p, ok, size in variants))
    return spark.createDataFrame([(store, raw)], "store string, raw string")


LEAVES = [("Unisex", None, None, None, 1), ("Men", None, None, None, 2), ("Unisex", "Western", "Upperwear", "Dress", 3), ("Men", "Western", None, None, 4)]
LEAF = "gender string, branch string, sub string, leaf string, category_id int"
STATE = "store string, native_id string, title string, description string, category_id int, price decimal(10,2), compare_at decimal(10,2), available boolean, first_seen string, last_seen string, is_active boolean"


def test_kids_sizes_tell_what_no_word_does(spark):
    """A dress from a men's store, sized 3-4Y, is no man's; without sizes the store decides."""
    from quarrymill.sources import stores

    leaves = spark.createDataFrame(LEAVES, LEAF)
    kids = stores.normalize_rest(rest_lines(spark, [(11, "5", True, "3-4Y")], store="furor"))
    adult = stores.normalize_rest(rest_lines(spark, [(11, "5", True, "M")], store="furor"))
    assert ingest.placed(kids, leaves)[0].first().category_id == 3 and ingest.placed(adult, leaves)[0].first().category_id == 4


def test_feed_variants(spark):
    from quarrymill.sources import stores

    row = stores.normalize_rest(rest_lines(spark, [(11, "9.50", True, "M"), (12, "8", False, "x")])).first()
    assert row.available and row.n_variants == 2 and row.sizes == ["M", "x"]
    assert [(v.variant_id, str(v.price), v.compare_at, v.available, v.color, v["size"], v.image) for v in row.variants] == [("11", "9.50", None, True, "Red", "M", "b"), ("12", "8.00", None, False, "Red", "x", "a")]
    out = stores.normalize_rest(rest_lines(spark, [(11, "9.50", True, "M")], "Hide-ATC")).first()
    assert not out.available and not out.variants[0].available
    none = stores.normalize_rest(rest_lines(spark, [])).first()
    assert none.variants == [] and none.sizes == [] and not none.available
    node = '{"id": "g1", "title": "t", "tags": [], "variants": {"edges": [{"node": {"id": "v1", "availableForSale": true, "price": {"amount": "7.0"}, "selectedOptions": [{"name": "Size", "value": "5-6Y"}, {"name": "Color", "value": "Red"}]}}]}}'
    graph = stores.normalize_graphql(spark.createDataFrame([("c", node), ("c", '{"id": "g2"}')], "store string, raw string")).orderBy("native_id").collect()
    assert graph[0].sizes == ["5-6Y"] and graph[0].variants[0].color == "Red" and str(graph[0].variants[0].price) == "7.00" and graph[0].available
    assert graph[1].variants == [] and graph[1].sizes == [] and not graph[1].available
    had = spark.createDataFrame([("a", "1", 11, "b"), ("a", "1", 12, "a")], "store string, native_id string, variant_id long, image string")
    fresh = stores.new_variant_images(had, rest_lines(spark, [(11, "9", True, "M"), (12, "8", True, "x")]), ingest.CHILD).collect()
    assert [(r.variant_id, r.image) for r in fresh] == [(11, "a")]  # only what changes


def test_daily_by_variant(spark):
    """unchanged; a price, a stock and a new size make the product updated; the history has a row a variant; a variant gone from the feed changes nothing."""
    from quarrymill.sources import stores

    leaves = spark.createDataFrame(LEAVES, LEAF)
    runs = spark.createDataFrame([("a", "2024-01-01", "completed")], "store string, started_at string, status string")
    feed_of = lambda *v, tags="": stores.normalize_rest(rest_lines(spark, v, tags))
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    m, x = (11, "9", True, "M"), (12, "8", True, "x")
    first = ingest.run("daily", spark.createDataFrame([], STATE), feed_of(m, x), leaves, runs, F.lit("2024-01-01"))
    assert [r.outcome for r in first.outcomes.collect()] == ["new"] and first.history.count() == 0
    counted = first.counters.first()
    assert counted.variants == 2 and counted.snapshots == 0
    state, variants = keep(first.state), keep(first.variants)

    def then(*v, tags="", tier="daily"):
        done = ingest.run(tier, state, feed_of(*v, tags=tags), leaves, runs, F.lit("2024-01-02"), variants=variants)
        return [r.outcome for r in done.outcomes.collect()], sorted((r.variant_id, str(r.price), r.available) for r in done.history.collect()), {r.variant_id: (str(r.price), r.available) for r in done.variants.collect()}

    assert then(m, x) == (["unchanged"], [], {"11": ("9.00", True), "12": ("8.00", True)})
    assert then((11, "9.5", True, "M"), x) == (["updated"], [("11", "9.50", True)], {"11": ("9.50", True), "12": ("8.00", True)})
    assert then(m, x, (13, "9", True, "L"))[:2] == (["updated"], [])  # a new size has no history yet
    # gone from the feed, and of one listed twice the last counts
    assert then((11, "1", True, "M"), m) == (["unchanged"], [], {"11": ("9.00", True), "12": ("8.00", True)})
    assert then(m, x, tags="cart-hide")[:2] == (["updated"], [("11", "9.00", False), ("12", "8.00", False)])
    hourly = then((11, "7", False, "M"), (13, "5", True, "L"), tier="hourly")
    assert hourly[1:] == ([("11", "7.00", False)], {"11": ("7.00", False), "12": ("8.00", True)})
    dry = ingest.run("daily", state, feed_of((11, "1", True, "M")), leaves, runs, F.lit("2024-01-02"), variants=variants, dry_run=True)
    assert sorted(str(r.price) for r in dry.variants.collect()) == ["8.00", "9.00"] and dry.history.count() == 1


def test_pieces_of_new_unstitched_products(spark):
    leaves = spark.createDataFrame(LEAVES, LEAF)
    runs = spark.createDataFrame([("a", "2024-01-01", "completed")], "store string, started_at string, status string")
    said = "Shirt: 3 meter Lawn, Dupatta: 2.5 m"
    rows = [("a", "1", "Unstitched Lawn Suit", "h", "", "", said, [], 5.0, None, True), ("a", "2", "Plain Shirt", "h", "", "", said, [], 5.0, None, True), ("a", "3", "Unstitched Suit", "h", "", "", said, [], 5.0, None, True)]
    state = spark.createDataFrame([("a", "3", "x", None, 1, None, None, True, "t", "t", True)], STATE)
    got = ingest.daily(state, spark.createDataFrame(rows, FEED), leaves, runs, F.lit("2024-01-01")).pieces.collect()
    assert sorted((r.native_id, r.sort_order, r.piece_name, r.fabric) for r in got) == [("1", 0, "Shirt", "Lawn"), ("1", 1, "Dupatta", None)]
