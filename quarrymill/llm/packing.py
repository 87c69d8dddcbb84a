"""Bounded-space online packing of token sequences.

A document's ids (with the separator at its end) are cut at multiples of the
window length; full windows are sequences of their own, the tails are packed.
Each partition keeps a fixed number of open windows: a tail goes into the open
window that it fits best; when none fits, the fullest is emitted and a new one
opened. So state is bounded whatever the input is. The windows still open at a
partition's end are merged in a second step, a fixed number of partitions to a
task, by best fit with the longest pieces first.

If the fullest window still has ``min_gap`` free slots or more when none fits,
the head of the tail is cut off to fill them, which the contract allows.
"""

from __future__ import annotations

import bisect
import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import map_batches, slices, table, written

WINDOW = 1024
OPEN_WINDOWS = 16
MIN_GAP = 16
MERGE_PARTITIONS = 16
SEPARATOR = 0
#: Sequence ids: the task in the upper bits, its running number in the lower ones; merged windows lie above all tasks.
TASK_BITS, MERGED = 36, 1 << 25
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's added token, a fixed value: its string in a text is this one id, as in the vocabulary's JSON form.
ADDED = {"<|endoftext|>": 50256}

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task int, is_open boolean"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("task", pa.int32()), ("is_open", pa.bool_())])


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The public byte-level BPE; its ranks and the added token give the same ids as the JSON form of the vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The text's ids, then the separator, as little-endian unsigned 32-bit numbers."""
    known = encoder(vocabulary)
    ids = known.encode(text, allowed_special="all") if any(x in text for x in ADDED) else known.encode_ordinary(text)
    ids.append(SEPARATOR)
    return np.array(ids, dtype="<u4")


class OpenWindows:
    """At most ``most`` open windows, ordered by what is free in them."""

    def __init__(self, size: int, most: int, min_gap: int):
        self.size, self.most, self.min_gap = size, most, min_gap
        self.free: list[tuple[int, int]] = []  # (free slots, window), ascending
        self.next = 0

    def place(self, length: int) -> Iterator[tuple[int, int, int]]:
        """Places a piece of up to ``size`` ids, maybe cut in two; yields (window, offset there, length)."""
        while length:
            k = bisect.bisect_left(self.free, (length, -1))
            if k < len(self.free):
                gap, window = self.free.pop(k)
                put = length
            elif self.most and len(self.free) < self.most:
                gap, window, put = self.size, self._new(), length
            else:
                gap, window = self.free.pop(0)  # the fullest is emitted
                if gap < self.min_gap:
                    continue
                put = gap
            yield window, self.size - gap, put
            length -= put
            if gap > put:
                bisect.insort(self.free, (gap - put, window))

    def _new(self) -> int:
        self.next += 1
        return self.next - 1


def packer(size: int, most: int, min_gap: int, vocabulary: str):
    """The first step, over the batches of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        base = task << TASK_BITS
        windows = OpenWindows(size, most, min_gap)
        held: dict[int, list[tuple]] = {}  # pieces of the windows that are open
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = token_ids(text or "", vocabulary)
                    raw, n = memoryview(ids.tobytes()), len(ids)
                    start = 0
                    while start < n:
                        if n - start >= size:
                            spots = [(windows._new(), 0, size)]
                        else:
                            spots = list(windows.place(n - start))
                        for window, offset, length in spots:
                            crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                            held.setdefault(window, []).append((doc_id, start, length, crc, n, base + window, offset, task))
                            start += length
                still = {w for _, w in windows.free}
                for window in [w for w in held if w not in still]:
                    rows += [(*x, False) for x in held.pop(window)]
                if rows:
                    yield _batch(rows)
        if rows := [(*x, True) for w in held for x in held[w]]:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def merger(size: int, per_task: int):
    """The second step: pieces of the open windows of some partitions, longest first, into windows without a bound on the open ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], kind="stable")
        windows = OpenWindows(size, 0, 0)
        windows.most = len(pdf) + 1
        base = (MERGED + int(pdf["task"].iloc[0]) // per_task) << TASK_BITS
        spots = [list(windows.place(int(n)))[0] for n in pdf["length"]]  # read to the end: what a window has left goes back after the yield
        return pdf.assign(sequence_id=[base + w for w, _, _ in spots], offset=[o for _, o, _ in spots])

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_gap: int = MIN_GAP, vocabulary: str = VOCABULARY, merge_partitions: int = MERGE_PARTITIONS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the separator alone. Repeated rows are packed as often as they occur; a null
    id stays null. A tail that fits several windows goes to the one with least room, of these to the oldest. Texts of any length are read whole. An empty table gives no rows; other columns are not read.
    """
    pieces = written(map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), packer(size, open_windows, min_gap, vocabulary), PIECE), "pieces")
    merged = pieces.where("is_open").groupBy(F.floor(F.col("task") / merge_partitions).alias("group")).applyInPandas(merger(size, merge_partitions), PIECE)
    return pieces.where("not is_open").unionByName(merged).drop("task", "is_open")


def op6_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 1024 ids, a row a piece."""
    return pack(table(spark, sf_dir, "documents"))
