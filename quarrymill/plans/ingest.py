"""The daily run over all stores' feeds: normalize, classify, place, compare with the state, and what follows from that.

A feed with ``variants`` is compared by variant: a product is updated if its own content, the state of one of its variants
or the set of its variants changes, and the history has a row a variant. A feed without them is compared by its offer. A
store's failure is a row in ``runs`` with status failed: its products are then neither updated nor delisted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.classify import classify, has_kids_sizing
from quarrymill.functions.scalars import pieces
from quarrymill.operators import enrich, maintain
from quarrymill.session import written

KEY = ["store", "native_id"]
CONTENT = ["title", "description", "category_id"]
OFFER = ["price", "compare_at", "available"]
CHILD = [*KEY, "variant_id"]
#: What a variant has besides its offer.
TRAITS = ["color", "size", "size_system", "sku", "image"]


@dataclass
class DailyRun:
    state: DataFrame  # the next version of the products
    outcomes: DataFrame  # store, native_id, outcome
    history: DataFrame  # rows to append: offers that changed, of variants where the feed has them
    counters: DataFrame  # a row a store
    excluded: DataFrame  # rows that are no products
    variants: DataFrame | None = None  # the next version of the variants
    pieces: DataFrame | None = None  # rows to append: the fabric pieces of new unstitched products


def placed(feed: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products with their category and construction, excluded rows) of a normalized feed; ``leaves`` has gender, branch, sub, leaf, category_id, with nulls for the levels above a leaf.

    A class whose leaf the tree lacks falls back to its branch, then to its gender. A feed's ``sizes`` tell children's
    clothes where no word does. The classes are written, so that all that a run derives from them classifies once.
    """
    kids = has_kids_sizing(F.col("sizes")) if "sizes" in feed.columns else F.lit(False)
    rows = classify(feed.withColumn("tags", F.array_join("tags", ",")).withColumn("kids_sizing", kids))
    rows = written(rows.select(*KEY, "title", "description", *OFFER, "class"), "classes")
    named = rows.where("class is not null").select("*", "class.gender", "class.branch", "class.sub", "class.leaf", "class.construction").withColumn("nothing", F.lit(None).cast("string"))
    full = [("gender", "gender"), ("branch", "branch"), ("sub", "sub"), ("leaf", "leaf")]
    branch = [("gender", "gender"), ("branch", "branch"), ("nothing", "sub"), ("nothing", "leaf")]
    gender = [("gender", "gender"), ("nothing", "branch"), ("nothing", "sub"), ("nothing", "leaf")]
    found = enrich.fallback_lookup(named, [(leaves, full, "category_id"), (leaves, branch, "category_id"), (leaves, gender, "category_id")], "category_id")
    cut = found.withColumn("title", F.substring("title", 1, 500))
    return cut.select(*KEY, *CONTENT, *OFFER, "construction"), rows.where("class is null").select(*KEY)


def variants_in(feed: DataFrame) -> DataFrame:
    """A row a variant of a feed; of one that is listed twice the last counts."""
    rows = feed.select(*KEY, F.posexplode("variants").alias("place", "v")).where("v.variant_id is not null")
    last = rows.groupBy(*KEY, F.col("v.variant_id").alias("variant_id")).agg(F.max_by("v", "place").alias("v"))
    return last.select(*CHILD, *[F.col(f"v.{c}").alias(c) for c in (*OFFER, *TRAITS)])


def with_variants(old: DataFrame | None, seen: DataFrame) -> DataFrame:
    """The next state of the variants: those seen as they are now, the others as they were."""
    if old is None:
        return seen
    return old.join(seen.select(*CHILD), CHILD, "left_anti").unionByName(seen)


def daily(state: DataFrame, feed: DataFrame, leaves: DataFrame, runs: DataFrame, now: Column, variants: DataFrame | None = None) -> DailyRun:
    """``state``: KEY, CONTENT, OFFER, first_seen, last_seen, is_active; ``variants``: CHILD, OFFER, TRAITS; ``runs``: store, started_at, status of this run."""
    good = runs.where("status = 'completed'").select("store")
    fed = feed.join(good, "store", "left_semi")
    seen, excluded = placed(fed, leaves)
    before = state.join(good, "store", "left_semi")
    offers = seen.drop("construction")
    if "variants" in feed.columns:
        children = variants_in(fed.join(excluded, KEY, "left_anti"))
        known = children.limit(0) if variants is None else variants
        changes = maintain.child_changes(known, children, CHILD, OFFER)
        outcomes = maintain.nested_outcomes(before.where("is_active"), offers, KEY, CONTENT, changes)
        # a product that was off the list is new to it, but its variants have a history
        history = changes.where("changed").select(*CHILD, *OFFER, now.alias("observed_at"))
        next_variants = with_variants(variants, children)
    else:
        outcomes = maintain.outcomes(before.where("is_active"), offers, KEY, CONTENT + OFFER)
        history, next_variants = maintain.snapshots(before, offers, KEY, OFFER, now), variants
    next_state = maintain.upsert(state, offers, KEY, CONTENT + OFFER, [], now)
    next_state = maintain.soft_delete(next_state, "store", runs, "last_seen")
    cloth = seen.where("construction = 'unstitched_fabric'").join(state, KEY, "left_anti")
    parts = cloth.select(*KEY, F.posexplode(pieces(F.col("description"))).alias("sort_order", "x")).select(*KEY, "sort_order", "x.*")
    return DailyRun(next_state, outcomes, history, maintain.run_counters(outcomes, "store"), excluded, next_variants, parts)


def hourly(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The state with offers of known products renewed; nothing is inserted."""
    return maintain.update_existing(state, seen, KEY, OFFER)


def hourly_variants(variants: DataFrame, feed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(the variants with the offers of known ones renewed, the history rows of those that changed); new variants wait for the daily run."""
    seen = variants_in(feed)
    changed = maintain.child_changes(variants, seen, CHILD, OFFER).where("changed")
    return maintain.update_existing(variants, seen, CHILD, OFFER), changed.select(*CHILD, *OFFER, now.alias("observed_at"))


def reclassified(feed: DataFrame, state: DataFrame, leaves: DataFrame) -> DataFrame:
    """store, native_id, category_id where classifying the kept raw rows again gives another category; a second run after applying gives none."""
    seen, _ = placed(feed, leaves)
    met = seen.select(*KEY, F.col("category_id").alias("fresh")).join(state.select(*KEY, "category_id"), KEY)
    return met.where(~F.col("fresh").eqNullSafe(F.col("category_id"))).select(*KEY, F.col("fresh").alias("category_id"))


def run(tier: str, state: DataFrame, feed: DataFrame, leaves: DataFrame, runs: DataFrame, now: Column, store: str | None = None, dry_run: bool = False, variants: DataFrame | None = None) -> DailyRun:
    """One run of a tier over all stores, or one: 'daily' does everything, 'hourly' renews the offers of known products.

    The rows of other stores stay as they are. A dry run classifies and counts, and its state is the old one.
    """
    if tier not in ("daily", "hourly"):
        raise ValueError(f"no such tier: {tier}")
    own = lambda df: df if store is None else df.where(F.col("store") == store)
    if tier == "daily":
        done = daily(own(state), own(feed), leaves, own(runs), now, None if variants is None else own(variants))
    else:
        good = own(runs).where("status = 'completed'").select("store")
        before, seen = own(state), own(feed).join(good, "store", "left_semi").select(*KEY, *OFFER)
        outcome = maintain.outcomes(before.join(seen, KEY, "left_semi"), seen.join(before, KEY, "left_semi"), KEY, OFFER)
        history, renewed = maintain.snapshots(before, seen, KEY, OFFER, now), None
        if variants is not None and "variants" in feed.columns:
            renewed, history = hourly_variants(own(variants), own(feed).join(good, "store", "left_semi"), now)
        done = DailyRun(hourly(before, seen), outcome, history, maintain.run_counters(outcome, "store"), maintain.unknown_keys(before, seen, KEY).where("not found"), renewed)
    rest = state.where(F.lit(False)) if store is None else state.where(~F.col("store").eqNullSafe(F.lit(store)))
    done.state = state if dry_run else done.state.unionByName(rest, allowMissingColumns=True)
    if variants is not None and done.variants is not None:
        others = variants.where(F.lit(False)) if store is None else variants.where(~F.col("store").eqNullSafe(F.lit(store)))
        done.variants = variants if dry_run else done.variants.unionByName(others)
    failed = own(runs).where("status <> 'completed'")
    done.counters = maintain.audit(own(runs), "store", done.outcomes, {"excluded": done.excluded, "errors": failed, "variants": variants_in(own(feed)) if "variants" in feed.columns else own(feed), "snapshots": done.history})
    return done


def status(runs: DataFrame) -> DataFrame:
    """The latest run of each store: store, started_at, status."""
    return runs.groupBy("store").agg(F.max_by(F.struct("started_at", "status"), "started_at").alias("x")).select("store", "x.*")
