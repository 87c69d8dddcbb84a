"""Line dedup: lines that many documents share are dropped, but for one document's. DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of ``LEAST_CHARS`` code
points or more are exploded as narrow rows (document, place of the line, 128-bit hash); texts don't cross this shuffle.
Distinct documents are counted per hash in two steps, first one row a document and hash and then partial counts of these,
so no task holds the documents of a key. Hashes of ``LEAST_DOCS`` documents or more then meet the lines again: the rows
of hot hashes stay where they are (``split_join``). The places to drop, one row a document, are joined to the texts, and
the other lines are put together again by their place. That table is written, so Spark knows its size: where few
documents have such lines it is broadcast and no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import hot_keys, split_join, table, written

LEAST_CHARS, LEAST_DOCS = 40, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: str) -> Column:
    """The lines of a text; null counts as empty, which is one empty line."""
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(_SPACE))
    # lower() is the same on ASCII, and far faster
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def keyed(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, tie, place, line: a row for each line long enough, ``line`` the hash of its key, ``tie`` that of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.posexplode(lines_of("text")).alias("place", "raw"))
    rows = rows.where(F.length(F.trim("raw", F.lit(_SPACE))) >= least_chars)
    return rows.select("doc_id", "tie", "place", F.unhex(F.md5(line_key(F.col("raw")))).alias("line"))


def shared_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """line, n (rows), last (the largest doc_id that holds it) of the hashes that ``least_docs`` documents or more hold."""
    once = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    # a null id is one document, and the smallest
    return once.groupBy("line").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.max("doc_id").alias("last")).where(F.col("docs") >= least_docs).select("line", "n", "last")


def places_to_drop(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, tie, places: the lines each text loses."""
    hot = hot_keys(shared, "line", lines.count())
    met = split_join(lines, shared.select("line", "last"), "line", hot).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return met.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("places"))  # at most a text's lines


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text (what is kept), n_lines, n_dropped of every row.

    A null or empty text is one empty line and is kept as an empty text. Rows that share an id are one document: they
    count once and all keep their lines if it is the largest; a null id is a document of its own, smaller than any
    other. Rows that repeat all stay. A line that a document holds twice is kept or dropped in both places. An empty
    table gives no rows; other columns are not read.
    """
    lines = written(keyed(docs, least_chars), "lines")
    shared = written(shared_lines(lines, least_docs), "shared")
    drops = written(places_to_drop(lines, shared), "drops").select(F.col("doc_id").alias("d2"), F.col("tie").alias("t2"), "places")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    met = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tie") == F.col("t2")), "left").withColumn("lines", lines_of("text"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(every, "places"), lambda i: F.element_at("lines", i + 1)), "\n")
    )
    return met.select("doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and dropped, and the hash of what is kept."""
    return drop_shared_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
each as (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from docs),
keyed as (select rid, doc_id, place, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') as key from each),
shared as (select key, max(doc_id) as last from keyed where length(key) >= {LEAST_CHARS} group by key having count(distinct doc_id) + max((doc_id is null)::int) >= {LEAST_DOCS}),
judged as (select rid, place, line, s.key is not null and k.doc_id is distinct from s.last as gone from keyed k left join shared s on k.key = s.key)
select d.doc_id, len(d.lines)::bigint as n_lines, j.n_dropped, sha256(j.kept) as kept_sha256
from docs d join (select rid, count(*) filter (gone)::bigint as n_dropped, coalesce(string_agg(line, chr(10) order by place) filter (not gone), '') as kept from judged group by rid) j on d.rid = j.rid
"""
