"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured once. Four rules count events (symbols, capitals, repeated lines, repeated words) and take
their odds, events to what is none, in millionths; the fifth takes the mean word length. The sketch of a rule is a
histogram whose buckets keep the six leading bits of the value: the error is under 1/32 of the value, the buckets are a
few hundred whatever the input, and sketches merge by adding counts. Sketches are made per language and source and
merged upwards to the language and to all; a group with fewer than ``LEAST_GROUP`` documents uses the sketch of its
language, and a language with fewer that of all documents.

No rule has a cutoff of its own. Values spread by factors, so the fence stands by factors: with the quartiles Q1 and Q3
of its group's sketch, a document is beyond Q3 * (Q3 / Q1) ** ``SPREAD``, and for word length also below
Q1 / (Q3 / Q1) ** ``SPREAD``. Most documents have no event at all, and what their number of words can't tell from none
counts as spread: the sketch takes each document's odds with one event more, the verdict with one less, so that one
event alone never decides. Documents then meet their group's thresholds by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import WORD, map_batches, slices, table, written

LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, per cent of words in repeated windows
LEAST_GROUP = 200
SPREAD = 2
#: The rules of events: what is counted, and in how many.
EVENTS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", "word_chars")}
LENGTH = "word_length"
RULES = (*EVENTS, LENGTH)
LEAD_BITS = 6

_WS, _SYMBOLS, _UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    found = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    m = len(ids)
    if m < 1 << 20:
        keys = (found[:-2] * m + found[1:-1]) * m + found[2:]
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        hit = np.isin(keys, twice)
    else:
        seen = Counter(zip(words, words[1:], words[2:]))
        hit = np.fromiter((seen[x] > 1 for x in zip(words, words[1:], words[2:])), bool, n - 2)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS``; a null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - gone(_WS), gone(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), gone(_UPPER)


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, ``carry`` and the counts of each row's whole text."""
    kept = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), *carry, F.col("text").cast("string"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = zip(*map(counts, part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*part.schema.names[:-1], *COUNTS])

    return map_batches(kept, run, schema)


def values(shift: int) -> dict[str, Column]:
    """Each rule's value of a document with words: odds in millionths with ``shift`` events more, word length in thousandths."""
    odds = lambda a, b: F.call_function("div", F.greatest(F.col(a) + shift, F.lit(0)) * 1_000_000, F.col(b) + 2 - shift - F.col(a))
    return {k: odds(*v) for k, v in EVENTS.items()} | {LENGTH: F.when(F.col("n_words") > 0, F.call_function("div", F.col("word_chars") * 1000, F.col("n_words")))}


def bucket(value: Column) -> Column:
    """The value with its six leading bits kept and the others cleared."""
    drop = F.greatest(F.length(F.bin(value)) - LEAD_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def edge(bucket: Column) -> Column:
    """The largest value of a bucket."""
    return bucket + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(bucket)) - LEAD_BITS, F.lit(0))) - 1


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketches per language and source of the documents that have words."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in values(1).items()]))
    rows = measured.where("n_words > 0").select("lang", "source", pairs.alias("x")).select("lang", "source", "x.rule", bucket(F.col("x.value")).alias("bucket"))
    return rows.groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: the counts added."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``keys``, rule, docs, q1, q3: the buckets that hold the quartiles."""
    group = Window.partitionBy(*keys, "rule")
    upto = F.sum("n").over(group.orderBy("bucket"))
    rows = sketch.withColumn("upto", upto).withColumn("docs", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bucket")))
    return rows.groupBy(*keys, "rule").agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """A row for each language and source that has a document with words: lang, source and hi_/lo_ of each rule."""
    own = quantiles(sketch, "lang", "source")
    by_lang = quantiles(merge(sketch, "lang"), "lang").select(F.col("lang").alias("l2"), F.col("rule").alias("r2"), F.col("docs").alias("docs2"), F.col("q1").alias("q12"), F.col("q3").alias("q32"))
    of_all = quantiles(merge(sketch)).select(F.col("rule").alias("r3"), F.col("q1").alias("q13"), F.col("q3").alias("q33"))
    met = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rule") == F.col("r2"))).join(of_all, F.col("rule") == F.col("r3"))
    pick = lambda a, b, c: F.when(F.col("docs") >= LEAST_GROUP, F.col(a)).when(F.col("docs2") >= LEAST_GROUP, F.col(b)).otherwise(F.col(c))
    met = met.select("lang", "source", "rule", pick("q1", "q12", "q13").alias("q1"), pick("q3", "q32", "q33").alias("q3"))
    met = met.withColumn("low", F.greatest("q1", F.lit(1)).cast("double")).withColumn("high", edge(F.col("q3")).cast("double")).withColumn("factor", F.col("high") / F.col("low"))
    hi, lo = F.col("high"), F.col("low")
    for _ in range(SPREAD):
        hi, lo = hi * F.col("factor"), lo / F.col("factor")
    at = lambda rule, x: F.max(F.when(F.col("rule") == rule, x))
    return met.groupBy("lang", "source").agg(*[at(r, hi).alias(f"hi_{r}") for r in RULES], at(LENGTH, lo).alias(f"lo_{LENGTH}"))


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept.

    A document without words (or with a null text) fails the base rules. Groups are matched with null as a value of
    its own; a value that equals its threshold is within it. Rows that repeat are judged alike and all stay; an empty
    table gives none.
    """
    names = [*[f"hi_{r}" for r in RULES], f"lo_{LENGTH}"]
    limits = written(thresholds(sketches(measured)), "thresholds").select(F.col("lang").alias("l2"), F.col("source").alias("s2"), *names)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    own = values(-1)
    verdict = ~F.col("base_failed")
    for r in RULES:
        verdict = verdict & F.coalesce(own[r] <= F.col(f"hi_{r}"), F.lit(True))
    verdict = verdict & F.coalesce(own[LENGTH] >= F.col(f"lo_{LENGTH}"), F.lit(True))
    met = measured.join(limits, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left")
    return met.withColumn("base_failed", base).withColumn("kept", verdict).drop("l2", "s2", *names)


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document; nulls, ties, repeats and empty tables as in ``judge``, other columns are not read."""
    judged = judge(written(measure(docs), "measured"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``documents``.

    The verdict meets the texts by id and a hash of the row, so rows that share an id are judged on their own, also
    where the id is null. A null or empty text fails. Rows that repeat all stay or all go; an empty table gives none.
    """
    tie = F.xxhash64("text", "lang", "source", "n_chars")
    judged = judge(written(measure(docs.withColumn("tie", tie), ("tie",)), "measured")).where("kept").select(F.col("doc_id").alias("d2"), F.col("tie").alias("t2")).distinct()
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("tie", tie)
    return rows.join(judged, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tie") == F.col("t2")), "left_semi").drop("tie")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return assess(table(spark, sf_dir, "documents"))


def _sql() -> str:
    odds = lambda a, b, k: f"greatest({a} + {k}, 0) * 1000000 // ({b} + 2 - {k} - {a})"
    value = lambda k: {r: odds(*v, f"({k})") for r, v in EVENTS.items()} | {LENGTH: "word_chars * 1000 // n_words"}
    rows = " union all ".join(f"select lang, source, '{r}' as rule, {v} as value from measured where n_words > 0" for r, v in value(1).items())
    quart = lambda keys, src: f"select {keys} rule, max(docs) as docs, min(bucket) filter (upto * 4 >= docs) as q1, min(bucket) filter (upto * 4 >= docs * 3) as q3 from (select *, sum(n) over (partition by {keys} rule order by bucket) as upto, sum(n) over (partition by {keys} rule) as docs from ({src})) group by {keys} rule"
    drop = lambda x: f"greatest(length(bin({x})) - {LEAD_BITS}, 0)::int"
    hi = ", ".join([f"max(case when rule = '{r}' then high{' * factor' * SPREAD} end) as hi_{r}" for r in RULES] + [f"max(case when rule = '{LENGTH}' then low{' / factor' * SPREAD} end) as lo_{LENGTH}"])
    within = " and ".join([f"coalesce({v} <= hi_{r}, true)" for r, v in value(-1).items()] + [f"coalesce({value(-1)[LENGTH]} >= lo_{LENGTH}, true)"])
    pick = lambda q: f"case when o.docs >= {LEAST_GROUP} then o.{q} when l.docs >= {LEAST_GROUP} then l.{q} else a.{q} end as {q}"
    base = f"(n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
    return f"""
with docs as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
words as (select rid, unnest(w) as w, generate_subscripts(w, 1) as p from (select rid, regexp_extract_all(text, '{WORD}') as w from docs)),
grams as (select rid, p, w, lead(w) over d as w2, lead(w, 2) over d as w3 from words window d as (partition by rid order by p)),
hits as (select rid, p from (select rid, p, count(*) over (partition by rid, w, w2, w3) as n from grams where w3 is not null) where n > 1),
covered as (select rid, count(distinct q) as n_repeat_words from (select rid, unnest([p, p + 1, p + 2]) as q from hits) group by rid),
lines as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '{WORD}') group by rid),
measured as (
  select d.rid, doc_id, lang, source, len(regexp_extract_all(text, '{WORD}'))::bigint as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper
  from docs d left join covered c on d.rid = c.rid left join lines l on d.rid = l.rid),
sketch as (select lang, source, rule, (value >> {drop("value")}) << {drop("value")} as bucket, count(*) as n from ({rows}) group by all),
own as ({quart("lang, source,", "select * from sketch")}),
by_lang as ({quart("lang,", "select lang, rule, bucket, sum(n) as n from sketch group by all")}),
of_all as ({quart("", "select rule, bucket, sum(n) as n from sketch group by all")}),
met as (select o.lang, o.source, o.rule, {pick("q1")}, {pick("q3")} from own o join by_lang l on o.lang is not distinct from l.lang and o.rule = l.rule join of_all a on o.rule = a.rule),
fences as (select *, greatest(q1, 1)::double as low, (q3 + (1::bigint << {drop("q3")}) - 1)::double as high, high / low as factor from met),
limits as (select lang, source, {hi} from fences group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} as base_failed, (not {base} and {within}) as kept
from measured m left join limits t on m.lang is not distinct from t.lang and m.source is not distinct from t.source
"""


OP2_SQL = _sql()
