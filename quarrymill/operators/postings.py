"""English full text as a postings table: written once, read by term.

A posting is a term (a stemmed word that is no stop word), the key of a row, and the term's positions among the row's words.
The table is laid in ranges of term and key, so a term that a third of all rows hold spreads over many files, and sorted, so
the statistics of files and row groups tell which of them hold a query's terms: a query reads these and no text. Beside
it stands one narrow row a text, its key and number of terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.stemming import STOP_WORDS, stem
from quarrymill.session import shared_folder

_WORD = re.compile(r"[^\W_]+")
#: What a term's rank adds up to at most, the sum of 1 / i^2, the weight of a plain word, and the positions that count; fixed values.
ALL_SQUARES, WEIGHT, MOST_POSITIONS = 1.64493406685, 0.1, 255
K1, B = 1.2, 0.75
#: Goes up when terms or layout change, so that an index of before isn't found.
VERSION = 2
#: Words that a worker keeps the terms of.
MOST_WORDS = 500_000


def terms(text: str) -> list[str]:
    """A query's distinct terms, in order."""
    return list(dict.fromkeys(stem(w) for w in _WORD.findall(text.lower()) if w not in STOP_WORDS))


class Index(NamedTuple):
    postings: DataFrame  # term, key, positions
    sizes: DataFrame  # key, n: the terms of each text


class _Codes(dict):
    """Numbers of the terms of words met, 0 for stop words; ``terms`` has the terms by number."""

    def __init__(self):
        super().__init__(dict.fromkeys(STOP_WORDS, 0))
        self.terms, self.numbers = [""], {"": 0}

    def __missing__(self, word: str) -> int:
        term = stem(word)
        if term not in self.numbers:
            self.numbers[term] = len(self.terms)
            self.terms.append(term)
        self[word] = self.numbers[term]
        return self[word]


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, ``key``, positions (from 1, among all words): a row a term of each text; null and empty texts have none, rows that share a key are texts of their own."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Codes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if len(met) > MOST_WORDS:
                    met = _Codes()
                words = [_WORD.findall((value.as_py() or "").lower()) for value in part.column(1)]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                code = np.fromiter(map(met.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(len(words)), sizes)
                place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                kept = np.flatnonzero(code)
                kept = kept[np.argsort(owner[kept] * len(met.terms) + code[kept], kind="stable")]
                code, owner, place = code[kept], owner[kept], place[kept]
                first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])][: len(code)])
                names = pa.array(met.terms, pa.string()).take(pa.array(code[first]))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)], pa.int32()), pa.array(place, pa.int32()))
                yield pa.RecordBatch.from_arrays([names, part.column(0).take(pa.array(owner[first])), lists], names=["term", key, "positions"])

    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"term string, `{key}` {kind}, positions array<int>")


def write_index(df: DataFrame, key: str, text: str, folder: str) -> Index:
    """Writes the two tables to ``folder`` and reads them back. The postings are written twice, as they come and in their ranges, so texts are read once."""
    postings(df, key, text).write.mode("overwrite").parquet(f"{folder}/raw")
    found = df.sparkSession.read.parquet(f"{folder}/raw")
    found.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{folder}/postings")
    sizes = df.select(key).distinct().join(found.groupBy(key).agg(F.sum(F.size("positions")).cast("long").alias("n")), key, "left")
    sizes.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n")).write.mode("overwrite").parquet(f"{folder}/sizes")
    return read_index(df, folder)


def read_index(df: DataFrame, folder: str) -> Index:
    read = df.sparkSession.read
    return Index(read.parquet(f"{folder}/postings"), read.parquet(f"{folder}/sizes"))


def _written(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at)
    except (Py4JError, TypeError, AttributeError):  # a session without a JVM at hand
        return False


def index_of(files: DataFrame, key: str, text: str) -> Index:
    """The index of a table read from files: written once to the shared folder and found again while the files are the same (by path, size and time)."""
    meta = F.col("_metadata")
    seen = files.select(F.xxhash64(meta["file_path"], meta["file_size"], meta["file_modification_time"]).alias("h")).distinct().agg(F.count("*").alias("n"), F.bit_xor("h").alias("x")).first()
    folder = f"{shared_folder(files.sparkSession)}/postings-v{VERSION}-{key}-{text}-{seen['n']}-{(seen['x'] or 0) & (2**64 - 1):016x}"
    if _written(files, f"{folder}/sizes/_SUCCESS"):
        return read_index(files, folder)
    return write_index(files, key, text, folder)


def _squares(times: Column) -> Column:
    """The sum of 1 / i^2 up to ``times``."""
    return F.aggregate(F.sequence(F.lit(1), times), F.lit(0.0), lambda s, i: s + F.lit(1.0) / (i * i))


def _exact_sum(part: Column) -> Column:
    """The sum of doubles, each rounded to 12 places first: whole numbers add up the same in any order, so texts that match alike tie whatever the shuffle."""
    return F.sum(F.round(part * 1e12).cast("long")) / F.lit(1e12)


def matches(index: Index, key: str, query: str | list[str], rank: str = "density") -> DataFrame:
    """``key`` and text_score of the texts that hold any of the query's terms.

    ``density``: for each term the sum of 1 / i^2 over its occurrences, weighted, as a share of all terms asked. ``bm25``:
    Okapi BM25 over the whole index. A term's part counts to 12 places. A query of stop words alone matches nothing.
    """
    asked = terms(query) if isinstance(query, str) else query
    held = index.postings.where(F.col("term").isin(asked))
    times = F.size("positions")
    if rank == "density":
        part = _squares(F.least(times, F.lit(MOST_POSITIONS))) * WEIGHT / ALL_SQUARES
        return held.groupBy(key).agg((_exact_sum(part) / max(1, len(asked))).alias("text_score"))
    if rank != "bm25":
        raise ValueError(f"no such rank: {rank}")
    stats = index.sizes.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))  # one row
    df = held.groupBy("term").agg(F.count("*").alias("df"))  # a row a term of the query
    tf = held.select("term", key, times.alias("tf")).join(F.broadcast(df), "term").join(index.sizes, key).join(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return tf.groupBy(key).agg(_exact_sum(score).alias("text_score"))


def indexed_leg(index: Index, key: str, query: str | list[str], k: int, rank: str = "density", within: DataFrame | None = None) -> DataFrame:
    """``key``, text_score and rank_t (long) of the ``k`` texts that match best, ties by key; ``within`` keeps the keys of a filtered set."""
    found = matches(index, key, query, rank)
    if within is not None:
        found = found.join(within.select(key).distinct(), key, "left_semi")
    order = [F.desc("text_score"), F.col(key)]
    return found.orderBy(*order).limit(k).withColumn("rank_t", F.row_number().over(Window.orderBy(*order)).cast("long"))
