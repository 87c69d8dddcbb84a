"""Language identification by compression.

For each language a raw-content dictionary of at most ``DICT_BYTES`` is laid down from learned documents.
A text is folded (lower case, ASCII digits and signs dropped), cut into blocks, and each block is compressed by zstandard
with each language's dictionary; the language with the smallest sum wins, ties go to the language with more documents.
The answer is rejected (``accepted`` false) when the runner-up's sum is within ``MARGIN`` of it.

The dictionaries are the bounded sample of labelled rows: ``DICT_BYTES`` a language. They are filled by whole documents in
the order of a hash of id and text, each that still fits; only where not even one fits is the first one cut to the size.
Rows that repeat are learned once, so copies under one id neither fill a dictionary nor leave it empty. All languages are
learned, each with a dictionary of its own: with very many the compressors of a worker take about 1 MB each. Every text is
classified whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import crc_class, map_batches, slices, table

DICT_BYTES = 128_000
DRAW = 1 << 40
LEVEL, MIN_MATCH, BLOCK = 6, 3, 2048
MARGIN = 0.02
#: Evidence per byte that a sum is smaller, for the score.
SHARPNESS = 0.5
UNKNOWN = "und"

_SPACE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_DROP = bytes(b for b in range(128) if not chr(b).isalpha() and b not in (9, 10, 11, 12, 13, 32))

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_SPACE, _DROP)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) of each learned language, those with most documents first, ties by name.

    Rows with a null text or language, or an empty text, teach nothing; an empty table gives an empty model. Documents
    are drawn by a hash of id and text, so reruns agree, and ids that repeat or are null do no harm; rows that repeat are
    learned once. A language of which the draw finds nothing teaches its first document in the hash's order.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("draw"), F.octet_length(F.col(text)).alias("size")).where("text is not null and lang is not null and size > 0")
    fits = F.col("size") < dict_bytes
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw").alias("kinds"), F.avg(F.when(fits, F.col("size"))).alias("bytes")).orderBy(F.desc("n"), "lang").collect()  # a row a language
    if not found:
        return []
    # a hash lets about three times the wanted documents of each language through, whatever their number
    wanted = {r["lang"]: -(-3 * dict_bytes // max(1, int(r["bytes"] or 1))) + 20 for r in found}
    share = rows.sparkSession.createDataFrame([(r["lang"], min(DRAW, -(-wanted[r["lang"]] * DRAW // r["kinds"]))) for r in found], "lang string, share long")
    sample = rows.where(fits).join(F.broadcast(share), "lang").where(F.pmod("draw", F.lit(DRAW)) < F.col("share")).groupBy("lang", "draw").agg(F.first("text").alias("text"), F.first("size").alias("size"))
    # of these the first ones: what goes to the driver is twice DICT_BYTES a language
    order = Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = sample.withColumn("upto", F.sum(F.col("size") + 1).over(order)).where(F.col("upto") <= 2 * dict_bytes)
    kept: dict[str, list[str]] = {r["lang"]: [] for r in found}
    left = dict.fromkeys(kept, dict_bytes)
    for row in sample.orderBy("lang", "draw").select("lang", "size", "text").collect():
        if row["size"] < left[row["lang"]]:
            left[row["lang"]] -= row["size"] + 1
            kept[row["lang"]].append(row["text"])
    if missing := [x for x, own in kept.items() if not own]:
        first = rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by(F.struct(F.substring("text", 1, dict_bytes).alias("text")), F.struct(~fits, "draw")).alias("x"))
        for row in first.select("lang", "x.text").collect():
            kept[row["lang"]].append(row["text"])
    return [(x, b" ".join(map(fold, own))[:dict_bytes]) for x, own in kept.items()]


@lru_cache(maxsize=2)
def compressors(model: tuple[tuple[str, bytes], ...]):
    import zstandard as z

    out = []
    for name, content in model:
        params = z.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=BLOCK, min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0)
        if len(content) >= 8:
            learned = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            learned.precompute_compress(compression_params=params)
            out.append((name, z.ZstdCompressor(dict_data=learned, compression_params=params)))
        else:
            out.append((name, z.ZstdCompressor(compression_params=params)))
    return out


def identify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, accepted); ``und``, 0 and false for a null text, one without a letter, or an empty model."""
    if not text or not model or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0, False
    raw = fold(text)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sums = np.array([sum(len(c.compress(b)) for b in blocks) for _, c in compressors(model)], dtype=float)
    best = int(sums.argmin())
    score = float(1 / np.exp(-SHARPNESS * np.minimum(sums - sums[best], 1e3)).sum())
    rest = np.delete(sums, best)
    return model[best][0], score, not len(rest) or bool(rest.min() - sums[best] >= MARGIN * rest.min())


def classify(docs: DataFrame, model: list[tuple[str, bytes]], held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row.

    A null text, or one without a letter, is ``und`` with score 0. A null id stays null and isn't held out. Ties go to
    the language with more documents. Rows that repeat are judged alike and all stay; an empty table gives no rows,
    other columns are not read. Texts of any length are compressed whole.
    """
    frozen = tuple(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                named, score, ok = zip(*(identify(t, frozen) for t in part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], schema=_ARROW)

    return map_batches(docs.select(F.col(key).cast("long"), F.coalesce(held_out, F.lit(False)), F.col(text)), run, SCHEMA)


def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_class("doc_id", 4) == 2
    return classify(docs, learn(docs.where(~held_out)), held_out)
