"""Incremental maintenance: differences of two states, upserts, snapshots, soft deletes, alerts.

Parquet has no MERGE: each operator returns the new state or the rows to append, and ``write_version`` puts a state in
a folder of its own, so no job reads and overwrites one path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(columns: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _keys(key: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def outcomes(old: DataFrame, new: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """key and outcome: new, updated (content differs), unchanged, vanished."""
    met = old.alias("o").join(new.alias("n"), _keys(key, "o", "n"), "full_outer")
    first = key[0]
    outcome = F.when(F.col(f"o.{first}").isNull(), "new").when(F.col(f"n.{first}").isNull(), "vanished").when(_same(content, "o", "n"), "unchanged").otherwise("updated")
    return met.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key], outcome.alias("outcome"))


def snapshots(old: DataFrame, new: DataFrame, key: list[str], state: list[str], observed_at: Column) -> DataFrame:
    """Rows to append to the history: the new state of keys that were there before, if it differs; none for brand-new keys."""
    met = new.alias("n").join(old.alias("o"), _keys(key, "n", "o"), "inner").where(~_same(state, "n", "o"))
    return met.select(*[F.col(f"n.{c}").alias(c) for c in [*key, *state]], observed_at.alias("observed_at"))


def child_changes(old: DataFrame, new: DataFrame, key: list[str], state: list[str]) -> DataFrame:
    """``key``, the new ``state``, is_new and changed (the state of a known child differs) of every child that was seen; ``key`` names parent and child."""
    met = new.select(*key, *state).alias("n").join(old.select(*key, *state, F.lit(True).alias("__there")).alias("o"), _keys(key, "n", "o"), "left")
    there = F.col("o.__there").isNotNull()
    return met.select(*[F.col(f"n.{c}").alias(c) for c in [*key, *state]], (~there).alias("is_new"), (there & ~_same(state, "n", "o")).alias("changed"))


def nested_outcomes(old: DataFrame, new: DataFrame, key: list[str], content: list[str], changes: DataFrame) -> DataFrame:
    """key, outcome, children, new_children, changed_children: a parent is updated if its own content differs, one of its children's state does, or it has a new child.

    ``changes`` are its children's (``child_changes``). Children that are gone from the feed change nothing.
    """
    n = lambda c: F.count_if(F.col(c))
    per = changes.groupBy(*key).agg(F.count("*").alias("children"), n("is_new").alias("new_children"), n("changed").alias("changed_children"))
    met = outcomes(old, new, key, content).join(per, key, "left")
    count = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("children", "new_children", "changed_children")}
    more = (F.col("outcome") == "unchanged") & (count["new_children"] + count["changed_children"] > 0)
    return met.select(*key, F.when(more, "updated").otherwise(F.col("outcome")).alias("outcome"), *[v.alias(c) for c, v in count.items()])


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The rows of ``new`` to append: the first arrival of each key that isn't there yet."""
    order = F.struct(*arrival)
    first = new.groupBy(*key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in key]), order).alias("__x")).select(*key, "__x.*").select(*new.columns)
    return first.join(old.select(*key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: list[str], keep: list[str], now: Column, seen_first: str = "first_seen", seen_last: str = "last_seen") -> DataFrame:
    """The new state: ``update`` columns come from ``new`` where it has the key, ``keep`` stay as they first were; sets the seen columns and is_active."""
    met = old.alias("o").join(new.alias("n"), _keys(key, "o", "n"), "full_outer")
    there = F.col(f"n.{key[0]}").isNotNull()
    pick = [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in update]
    stay = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keep]
    seen = [F.coalesce(F.col(f"o.{seen_first}"), now).alias(seen_first), F.when(there, now).otherwise(F.col(f"o.{seen_last}")).alias(seen_last)]
    return met.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key], *pick, *stay, *seen, F.when(there, True).otherwise(F.col("o.is_active")).alias("is_active"))


def assign_ids(old: DataFrame, names: DataFrame, name: str, fold: Column, arrival: list[str]) -> DataFrame:
    """id and name of the values that the dimension lacks: ids follow on from its greatest, in the order of arrival; of spellings that fold alike the first to arrive stands.

    Ids are given in two levels, ranges of the order and places within one, so that no task holds all new values.
    """
    known = old.select(F.lower(F.trim(F.col(name))).alias("__f"))
    at = F.struct(*arrival)
    rows = names.withColumn("__f", fold).where("__f is not null and __f <> ''")
    fresh = rows.groupBy("__f").agg(F.min_by(F.trim(F.col(name)), at).alias(name), F.min(at).alias("__at")).join(known, "__f", "left_anti")
    ranged = fresh.repartitionByRange("__at", "__f").withColumn("__part", F.spark_partition_id())
    before = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # at most a row a shuffle partition
    before = before.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__at", "__f"))
    placed = ranged.withColumn("__place", place).join(F.broadcast(before), F.col("__part") == F.col("__p")).join(F.broadcast(top))
    return placed.select((F.col("__top") + F.col("__base") + F.col("__place")).cast("long").alias("id"), name)


def replace_lists(old: DataFrame, new: DataFrame, key: str, value: str, position: str, most: int = 12) -> DataFrame:
    """key, value, position of the lists that differ from the old ones, in order, cut to ``most``."""
    gather = lambda df, n: df.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda x: x[value]), 1, most).alias(n))
    met = gather(new, "__new").join(gather(old, "__old"), key, "left").where(~F.col("__new").eqNullSafe(F.col("__old")))
    return met.select(key, F.posexplode("__new").alias(position, value)).select(key, value, position)


def update_existing(old: DataFrame, seen: DataFrame, key: list[str], state: list[str]) -> DataFrame:
    """``old`` with the state of the keys that were seen again; keys that it lacks are skipped, never inserted."""
    met = old.alias("o").join(seen.alias("n"), _keys(key, "o", "n"), "left")
    there = F.col(f"n.{key[0]}").isNotNull()
    return met.select(*[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in state else F.col(f"o.{c}").alias(c) for c in old.columns])


def soft_delete(state: DataFrame, store: str, runs: DataFrame, last_seen: str) -> DataFrame:
    """``state`` with is_active false for rows not seen since the start of a run of their store that ended cleanly (runs: store, started_at, status)."""
    clean = runs.where("status = 'completed'").groupBy(F.col("store").alias("__s")).agg(F.max("started_at").alias("__at"))
    met = state.join(clean, F.col(store) == F.col("__s"), "left")
    return met.withColumn("is_active", F.col("is_active") & ~F.coalesce(F.col(last_seen) < F.col("__at"), F.lit(False))).drop("__s", "__at")


def canary(runs: DataFrame, store: str, order: str, fetched: str, drop: float = 0.30) -> DataFrame:
    """``runs`` with prior (the last completed run's count before) and alert: fetched something, but less than prior by more than the share."""
    before = Window.partitionBy(store).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("status") == "completed", F.col(fetched)), ignorenulls=True).over(before)
    alert = (F.col(fetched) > 0) & (F.col(fetched) < F.col("prior") * (1 - drop))
    return runs.withColumn("prior", prior).withColumn("alert", F.coalesce(alert, F.lit(False)))


def alert_messages(runs: DataFrame, store: str, fetched: str) -> DataFrame:
    """message: a row for each run that ``canary`` finds fault with, or that failed; what the alert sink takes."""
    told = F.when(F.col("status") != "completed", F.concat(F.col(store).cast("string"), F.lit(": run failed")))
    fell = F.when(F.col("alert"), F.concat(F.col(store).cast("string"), F.lit(": fetched "), F.col(fetched).cast("string"), F.lit(" of "), F.col("prior").cast("string"), F.lit(" before")))
    return runs.select(F.coalesce(told, fell).alias("message")).where("message is not null")


def history(changes: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Validity intervals of a change table: valid_from, valid_to (null: still), previous value."""
    by = Window.partitionBy(*key).orderBy(at)
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(by)).withColumn("previous", F.lag(value).over(by))


def run_counters(outcome: DataFrame, store: str) -> DataFrame:
    """One audit row a store: products_new, _updated, _unchanged, _removed."""
    n = lambda x: F.count_if(F.col("outcome") == x).cast("long")
    return outcome.groupBy(store).agg(n("new").alias("products_new"), n("updated").alias("products_updated"), n("unchanged").alias("products_unchanged"), n("vanished").alias("products_removed"))


def audit(stores: DataFrame, store: str, outcome: DataFrame, counted: dict[str, DataFrame]) -> DataFrame:
    """The run's audit: every store with the outcomes' counters and, by name, the number of its rows in other tables (excluded, errors, variants, snapshots); zero where it has none."""
    out = stores.select(store).distinct().join(run_counters(outcome, store), store, "left")
    for name, rows in counted.items():
        out = out.join(rows.groupBy(store).agg(F.count("*").alias(name)), store, "left")
    return out.select(store, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in out.columns if c != store])


def unknown_keys(old: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """key, found: what a targeted update asked for, and whether the state has it; the others are reported, never inserted."""
    asked = seen.select(*key).distinct()
    there = old.select(*key).distinct().withColumn("__there", F.lit(True))
    return asked.join(there, key, "left").select(*key, F.col("__there").isNotNull().alias("found"))


def set_flag(rows: DataFrame, flag: str, hit: Column, undo: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with the flag taken from those that the predicate hits, or given back with ``undo``; one row with the number that this changes)."""
    hits = F.coalesce(hit, F.lit(False))
    changes = hits & (F.col(flag) != F.lit(undo))
    return rows.withColumn(flag, F.when(hits, F.lit(undo)).otherwise(F.col(flag))), rows.agg(F.count_if(changes).alias("n"))


def without_excluded(state: DataFrame, excluded: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the state without the rows that the classifier now excludes, the rows deleted)."""
    gone = excluded.select(*key).distinct()
    return state.join(gone, key, "left_anti"), state.join(gone, key, "left_semi")


def force_unavailable(variants: DataFrame, out: DataFrame, product: str, available: str, observed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(variants with those of the products ``out`` (one column) unavailable, the history rows of those that were available)."""
    named = variants.join(out.select(F.col(out.columns[0]).alias("__p")).distinct().withColumn("__out", F.lit(True)), F.col(product) == F.col("__p"), "left").drop("__p")
    hit = F.col("__out").isNotNull()
    changed = named.where(hit & F.col(available)).drop("__out").withColumn(available, F.lit(False)).withColumn("observed_at", observed_at)
    return named.withColumn(available, F.col(available) & ~hit).drop("__out"), changed


def write_version(df: DataFrame, folder: str, version: str, options: dict[str, str] | None = None) -> str:
    """Writes a state as one version; readers follow the versions in order, so a load that fails half-way is never read."""
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return path


def lookup_options(columns: dict[str, int], row_group: int = 128 << 20) -> dict[str, str]:
    """Options of a Parquet writer for lookups: a bloom filter on each column, sized for its number of different values in a file, in row groups of so many bytes.

    The table is clustered by something else; a lookup of a key reads the row groups whose filters may hold it.
    """
    out = {"parquet.block.size": str(row_group)}
    for name, distinct in columns.items():
        out |= {f"parquet.bloom.filter.enabled#{name}": "true", f"parquet.bloom.filter.expected.ndv#{name}": str(distinct)}
    return out


def full_refresh(feed: DataFrame, folder: str, version: str, key: list[str], arrival: list[str], by: str, lookups: dict[str, int] | None = None) -> DataFrame:
    """A load from nothing: the first arrival of each key, clustered by a column that requests filter on, as a version of its own; returns it as read back.

    ``lookups``: columns that requests look up by value, with the number of different values that a file may hold.
    """
    first = feed.groupBy(*key).agg(F.min_by(F.struct(*[c for c in feed.columns if c not in key]), F.struct(*arrival)).alias("__x")).select(*key, "__x.*")
    laid = first.repartitionByRange(by, *key).sortWithinPartitions(by, *key)  # row groups with narrow ranges instead of an index
    return feed.sparkSession.read.parquet(write_version(laid, folder, version, lookup_options(lookups) if lookups else {}))
