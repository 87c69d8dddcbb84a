"""Mixing sources to target weights by a low-discrepancy source schedule.

1. Sizes (words) are summed by source; target words follow from the weights, capped at ``MAX_EPOCHS`` passes
   over a source, the excess reshared by weight: the level (words a unit of weight) rises until no source that isn't
   stopped lies above its cap, each step one aggregation over the sources.
2. Each source's documents are put in a shuffled order (md5 of seed, id and text) and that stream of words is cut into
   blocks that differ by one word at most, the longer ones evenly among the others; a source's quota is its target in blocks.
3. Slot i of the schedule has the golden-ratio point frac(i * phi), as an integer of 32 bits. Mapped through the
   cumulative quotas it names a source; slots are ranked per source, and the r-th slot of a source takes its block
   r modulo the number of its blocks. So any run of slots holds the sources in the target proportions within a few
   blocks. Slots beyond a quota are passed over; quota that the points leave open is appended as a tail, so every
   source gets its quota exactly.
4. A document belongs to the slots of the blocks that hold its words; ``mix_rows`` gives the rows in the slots' order.

Nothing is ordered in one task: the shuffled order, the slots' ranks and the order of the sources are prefix sums in
two levels (short runs, then sums of runs). Points meet the cumulative quotas by an equi-join on the upper bits, not by
a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import WORD, table, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 65_536
LEAST_BLOCKS = 1024
SEED = "mix-1"
#: floor(2^32 / golden ratio), the step of the integer golden-ratio sequence; there are at most 2^31 slots.
GOLDEN_STEP = 2_654_435_769
POINT_BITS, JOIN_BITS = 32, 10
RUN_ROWS, RUN_SLOTS = 20_000, 8_192


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words), tie (hash of the row, to tell rows with one id apart), order key, copies (rows that are equal in all these); no text."""
    tie = F.xxhash64(F.col(text), F.col(source), *[F.col(c) for c in extra])
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    each = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), tie.alias("tie"), key.alias("key"))
    return each.groupBy("doc_id", "source", "size", "tie", "key").agg(F.count("*").alias("copies"))


def upto(parted: DataFrame, value: str, name: str) -> DataFrame:
    """``parted`` (sources in ranges ``part``) with the sum of ``value`` over the sources up to and with each, in their order."""
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    before = parted.groupBy("part").agg(F.sum(value).alias("n"))  # a row a range: at most as many as shuffle partitions
    before = before.select(F.col("part").alias("p2"), (F.sum("n").over(Window.partitionBy().orderBy("part")) - F.col("n")).alias("base"))
    return parted.withColumn(name, F.sum(value).over(own)).join(before, F.col("part") == F.col("p2")).withColumn(name, F.col(name) + F.col("base")).drop("p2", "base")


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words a unit of weight when every source takes its weight's share but none more than ``max_epochs`` times its size.

    It rises from the level without caps; each round stops the sources above their cap and reshares, so it ends at the
    exact level, after few rounds. Only sums go to the driver.
    """
    level, was = 0.0, None
    while level != was:
        was = level
        stopped = F.lit(was) * F.col("weight") > F.col("source_size") * max_epochs
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(stopped, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if not row["all"] or not row["free"]:
            break
        level = (row["all"] - max_epochs * row["held"]) / row["free"]
    return level


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """A row a source (null is one): source, source_size, n_docs, target, n_blocks, quota, slots (of all), lo and hi of its points."""
    totals = written(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_docs")), "totals")
    parted = written(totals.repartitionByRange(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.lit(1).alias("one")), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = written(upto(parted, "one", "place").withColumn("weight", weight.cast("double")), "weights")
    size, level = F.col("source_size"), water_level(weighed, max_epochs)
    blocks = F.least(size, F.greatest(F.lit(least_blocks).cast("long"), F.ceil(size / block_words)))
    quota = F.when(size == 0, F.lit(0)).otherwise(F.least(F.col("n_blocks") * max_epochs, F.floor(F.col("n_blocks") * F.col("target") / size + 0.5)))
    out = weighed.withColumn("target", F.least((size * max_epochs).cast("double"), F.lit(level) * F.col("weight"))).withColumn("n_blocks", blocks.cast("long")).withColumn("quota", quota.cast("long"))
    slots = F.lit(out.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])  # one number
    point = lambda c: F.when(slots == 0, F.lit(0)).otherwise(F.floor(c / slots * float(1 << POINT_BITS))).cast("long")
    return upto(out, "quota", "upto").select("source", "source_size", "n_docs", "target", "n_blocks", "quota", slots.alias("slots"), point(F.col("upto") - F.col("quota")).alias("lo"), point(F.col("upto")).alias("hi"))


def schedule(targets: DataFrame) -> DataFrame:
    """source, slot, turn: the slots of the schedule, each source's turns counted from 0 up to its quota."""
    spark = targets.sparkSession
    slots = targets.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]  # one number
    shift = POINT_BITS - JOIN_BITS
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN_STEP, F.lit(1 << POINT_BITS)).alias("u"))
    points = points.withColumn("cell", F.shiftright("u", shift))
    spans = targets.where("quota > 0").select("source", "quota", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    named = points.join(spans, "cell").where("u >= lo and u < hi").select("source", "quota", "slot", F.floor(F.col("slot") / RUN_SLOTS).alias("run"))
    runs = named.groupBy("source", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n"))
    in_run = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    numbered = named.withColumn("turn", in_run).join(runs.select(F.col("source").alias("s2"), F.col("run").alias("r2"), "base"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("run") == F.col("r2")))
    numbered = numbered.withColumn("turn", F.col("turn") + F.col("base")).where("turn < quota").select("source", "slot", "turn")
    got = runs.groupBy("source").agg(F.sum("n").alias("got")).select(F.col("source").alias("s2"), "got")
    short = targets.join(got, F.col("source").eqNullSafe(F.col("s2")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    tail = short.select("source", "slots", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("turn")).select("source", (F.col("slots") + F.col("turn")).alias("slot"), "turn")
    return numbered.unionByName(tail)


def placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row a document (equal ones each for itself), with first and upto, the words of its source's shuffled stream that it is, and its source's row."""
    per_run = Window.partitionBy("source", "run").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = targets.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]  # one number
    digits = next(d for d in range(1, 9) if rows <= RUN_ROWS * 16**d or d == 8)
    words = F.col("size") * F.col("copies")
    cut = sizes.withColumn("run", F.substring("key", 1, digits))
    runs = cut.groupBy("source", "run").agg(F.sum(words).alias("n"))
    runs = runs.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).select(F.col("source").alias("s2"), F.col("run").alias("r2"), "base")
    out = cut.withColumn("first", F.sum(words).over(per_run) - words).join(runs, F.col("source").eqNullSafe(F.col("s2")) & (F.col("run") == F.col("r2")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("first", F.col("first") + F.col("base") + F.col("copy") * F.col("size")).withColumn("upto", F.col("first") + F.col("size"))
    own = targets.select(F.col("source").alias("s3"), "source_size", "target", "n_blocks")
    return out.drop("s2", "r2", "run", "base", "key", "copies", "copy").join(own, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _start(j: Column) -> Column:
    """The first word of block ``j``: floor(j * source_size / n_blocks), without a product beyond 64 bits."""
    size, n = F.col("source_size"), F.col("n_blocks")
    return (j * _div(size, n) + _div(j * (size % n), n)).cast("long")


def _block(x: Column) -> Column:
    """The block that holds word ``x`` of a source: a guess in doubles, which is off by one at most, set right."""
    guess = F.floor(x / F.col("source_size") * F.col("n_blocks")).cast("long")
    return guess + F.when(_start(guess + 1) <= x, 1).when(_start(guess) > x, -1).otherwise(0)


def taken_pieces(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each document, block that shares words with it, and slot that takes the block: the document, lo and hi (words of the stream), pass (over the source) and slot."""
    docs = placed(sizes, targets).where("size > 0")
    pieces = docs.withColumn("block", F.explode(F.sequence(_block(F.col("first")), _block(F.col("upto") - 1))))
    pieces = pieces.withColumn("lo", F.greatest("first", _start(F.col("block")))).withColumn("hi", F.least("upto", _start(F.col("block") + 1)))
    own = targets.select(F.col("source").alias("s3"), F.col("n_blocks").alias("n3"))
    turns = schedule(targets).join(own, F.col("source").eqNullSafe(F.col("s3")))
    turns = turns.select(F.col("source").alias("s2"), (F.col("turn") % F.col("n3")).alias("b2"), _div(F.col("turn"), F.col("n3")).alias("pass"), "slot")
    return pieces.join(turns, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2"))).drop("s2", "b2")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), first_slot (the first slot that takes words of it, null if none does).

    A null text has no words; null is a source of its own, last in order; a null id is ordered as an empty one. Ties
    in the shuffled order go to the smaller id, then the shorter text, then the smaller hash of the row; rows equal in
    all follow each other. Rows that repeat are mixed as often as they occur. An empty table gives no rows, and where
    no text has words nothing is taken. Other columns are not read.
    """
    sizes = written(measured(docs, doc_id, text, source), "sizes")
    targets = written(source_targets(sizes), "targets")
    took = taken_pieces(sizes, targets).groupBy("source", "first").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("first_slot")).select(F.col("source").alias("s2"), F.col("first").alias("f2"), "taken", "first_slot")
    there = placed(sizes, targets)
    full = there.where("size > 0").join(took, F.col("source").eqNullSafe(F.col("s2")) & (F.col("first") == F.col("f2")), "left")
    out = full.unionByName(there.where("size = 0"), allowMissingColumns=True)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mix_rows(docs: DataFrame) -> DataFrame:
    """``documents`` as the mix takes them, in the order of the schedule's slots, in ranges of it by partition.

    A document taken twice comes in two rows, each at the first slot of that pass that takes it; one cut by a block's
    border has its words of that side, joined by spaces. Documents without words (null and empty texts) are not taken.
    Rows that repeat come each for itself, a null id stays null and is not an id 0. An empty table gives no rows.
    Columns: doc_id, text, lang, source, n_chars (the code points of the row's text); others are dropped.
    """
    extra = ("lang", "n_chars")
    sizes = written(measured(docs, extra=extra), "sizes")
    targets = written(source_targets(sizes), "targets")
    cuts = taken_pieces(sizes, targets).groupBy("source", "first", "doc_id", "tie", "size", "pass").agg((F.min("lo") - F.col("first")).alias("lo"), (F.max("hi") - F.col("first")).alias("hi"), F.min("slot").alias("slot"))
    # keys without nulls, the same for both steps: texts move once to meet their cuts, and once into the slots' order
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("no_id")]
    cuts = cuts.select("tie", *keys, "size", "lo", "hi", "slot", "first")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("tie", F.xxhash64("text", "source", *extra)).select("*", *keys).dropDuplicates(["tie", "k", "no_id"])
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    part = F.array_join(F.slice(words, (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    text = F.when((F.col("lo") == 0) & (F.col("hi") == F.col("size")), F.col("text")).otherwise(part)
    out = rows.join(cuts, ["tie", "k", "no_id"]).select("doc_id", text.alias("text"), "lang", "source", "slot", "first")
    out = written(out, "mixed")  # the ranges are found on a sample: the join isn't made twice
    ordered = out.repartitionByRange("slot", "first", "doc_id").sortWithinPartitions("slot", "first", "doc_id")
    return ordered.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def op5_mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights 5, 2, 1 repeating over the sources."""
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
totals as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (
  select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from totals),
levelled as (
  select *, source_size * {MAX_EPOCHS} / weight as ratio,
         (sum(source_size) over () - {MAX_EPOCHS} * coalesce(sum(source_size) over (order by source_size * {MAX_EPOCHS} / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::bigint
         / sum(weight) over (order by source_size * {MAX_EPOCHS} / weight, source nulls last rows between current row and unbounded following) as level
  from weighed),
lam as (select arg_min(level, ratio) as lam from levelled where level * weight <= source_size * {MAX_EPOCHS}),
targets as (
  select source, source_size, case when source_size = 0 then 0.0::double else least((source_size * {MAX_EPOCHS})::double, coalesce(lam * weight, (source_size * {MAX_EPOCHS})::double)) end as target,
         least(source_size, greatest({LEAST_BLOCKS}, ceil(source_size / {BLOCK_WORDS}::double)::bigint))::bigint as n
  from levelled, lam),
quotas as (
  select *, case when n = 0 then 0 else least(n * {MAX_EPOCHS}, floor(n * target / source_size + 0.5)::bigint) end as quota,
         case when n = 0 then 0 else source_size // n end as q, case when n = 0 then 0 else source_size % n end as r from targets),
spans as (
  select *, case when n = 0 then 0 else quota // n end as passes,
         case when n = 0 then 0 else (quota % n) * q + (quota % n) * r // n end as rest from quotas),
placed as (
  select s.doc_id, s.source, s.size, p.source_size, p.target, p.passes, p.rest, p.n,
         (sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows unbounded preceding) - s.size)::bigint as first
  from sizes s join spans p on s.source is not distinct from p.source),
cumulated as (
  select source, quota, slots, floor((upto - quota) / slots::double * {float(1 << POINT_BITS)})::bigint as lo, floor(upto / slots::double * {float(1 << POINT_BITS)})::bigint as hi
  from (select source, quota, sum(quota) over () as slots, sum(quota) over (order by source nulls last) as upto from spans) where slots > 0),
points as (select i as slot, (i * {GOLDEN_STEP}) % {1 << POINT_BITS} as u from (select unnest(range(0, slots::bigint)) as i from (select max(slots) as slots from cumulated))),
named as (select source, quota, slot, row_number() over (partition by source order by slot) - 1 as turn from points join cumulated on u >= lo and u < hi),
got as (select c.source, c.quota, c.slots, count(n.slot) as got from cumulated c left join named n on c.source is not distinct from n.source group by c.source, c.quota, c.slots),
schedule as (
  select source, slot, turn from named where turn < quota
  union all select source, slots + turn, turn from (select source, slots, unnest(range(got, quota)) as turn from got where got < quota))
select doc_id, size, source_size, target, (passes * size + greatest(0, least(first + size, rest) - first))::bigint as taken, slot::bigint as first_slot
from placed p left join schedule s
  on p.size > 0 and p.source is not distinct from s.source and s.turn = (((first + 1)::hugeint * n - 1) // nullif(source_size, 0))::bigint
"""
