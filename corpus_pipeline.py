"""A corpus from documents: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``. Every stage works on all rows that it gets; its
statistics (thresholds, the field's weights, targets) are those of its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import mixing, neardup, packing, pii, quality
from quarrymill.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null and empty texts fail and go. Rows that repeat are judged alike: all stay or all go; a value that equals its
    threshold is within it. A null id, lang or source is a value of its own. An empty table gives none.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity 0.8), the one with the smallest id.

    Documents without words link with nothing and stay. Of rows that share an id one stays, rows without an id all
    stay. An empty table gives none.
    """
    return neardup.keep_one(docs, 5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind.

    Every row stays, repeated ones alike, null texts null; of spans that begin together the kind listed first names
    them. An empty table gives none.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target words, in the order of the schedule; what the mix takes again comes again.

    Null and empty texts have no words and are not taken. Rows that repeat are mixed each for itself; ties in the
    shuffled order go by id, size and hash. A null source is a source, a null id stays null. An empty table gives none.
    """
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as sequences, a row a piece.

    A null or empty text is one piece, the separator alone. Rows that repeat are packed as often as they occur, a null
    id stays null; a tail that fits several windows goes to the fullest of them. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Neither the near-duplicates' components nor the field and the tokenizer are expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
