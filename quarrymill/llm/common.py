"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; the pattern reads the same in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key is hot with more than ``HOT_ROWS`` rows and more than one in ``HOT_KEYS`` of all: there are at most so many, few enough to broadcast.
HOT_ROWS, HOT_KEYS = 400, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` in the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it names none, a local session (tests, a laptop) takes a folder of its own; on a cluster that would be a
    different folder on each machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: it cuts lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; Spark splits and schedules, ``fn`` sees one bounded batch at a time.

    Batches are bounded by bytes too, as texts may be long, unless the session says otherwise.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, "8m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # workers are used again: they keep nothing of this task

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short runs of a batch, so that what is made of it stays small beside it."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def crc_class(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def hot_keys(counted: DataFrame, key: str, total: int) -> DataFrame:
    """key, n of the hot keys, of a table (key, n) of ``total`` rows in all."""
    return written(counted.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select(key, "n"), "hot")


def split_join(big: DataFrame, one: DataFrame, key: str, hot: DataFrame | None = None, how: str = "inner", total: int = 0) -> DataFrame:
    """``big`` joined with ``one`` (a row a key; ``how`` inner or left): rows of hot keys stay where they are and meet a broadcast of their keys' rows, which are at most ``HOT_KEYS``; the others are joined by a shuffle.

    Without ``hot`` the hot keys are counted first; ``total`` is then the number of rows of ``big``.
    """
    if hot is None:
        hot = hot_keys(big.groupBy(key).agg(F.count("*").alias("n")), key, total)
    if hot.isEmpty():
        return big.join(one, key, how)
    near = F.broadcast(hot.select(F.col(key).alias("hot_key")))
    tagged = big.join(near, F.col(key) == F.col("hot_key"), "left")
    rest = tagged.where("hot_key is null").drop("hot_key").join(one.join(near, F.col(key) == F.col("hot_key"), "left_anti"), key, how)
    heavy = tagged.where("hot_key is not null").drop("hot_key").join(F.broadcast(one.join(near, F.col(key) == F.col("hot_key"), "left_semi")), key, how)
    return rest.unionByName(heavy)


def drawn(df: DataFrame, by: list[str], wanted: int) -> DataFrame:
    """About ``wanted`` rows, at most twice as many, by a hash of the columns ``by``; all of them where there are no more.

    Where rows are drawn, those that repeat in ``by`` are drawn once. The hash takes texts too, so ids that repeat or are null neither
    empty nor flood the sample; where most rows are copies the draw is made anew over the number of different ones.
    """
    n = df.count()
    if n <= 2 * wanted:
        return df

    def take(every: int) -> DataFrame:
        rows = df.withColumn("draw", F.xxhash64(*by)).where(F.pmod("draw", F.lit(every)) == 0)
        return written(rows.groupBy("draw").agg(F.first(F.struct(*df.columns)).alias("row")), "drawn")

    rows = take(n // wanted)
    got = rows.count()
    if 2 * got < wanted:
        different = df.agg(F.approx_count_distinct(F.xxhash64(*by))).first()[0]
        rows = take(max(1, different // wanted))
        got = rows.count()
    if got > 2 * wanted:
        rows = rows.where(F.pmod(F.xxhash64("draw"), F.lit(got // wanted)) == 0)
    return rows.select("row.*")
