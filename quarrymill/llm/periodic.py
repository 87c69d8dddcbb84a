"""Runs of periodic words, found by internal pattern matching.

A run is a stretch of words with smallest period q, of ``LEAST_LENGTH`` words and ``LEAST_TIMES`` periods or more, that no
neighbouring word extends. Let B be the largest power of two up to q (but 8 at least). A run has 2B - 1 + q words or more,
so some block of B words at a multiple of B lies in it together with its copy q words on. So of every dyadic block the
occurrences in the neighbouring window, B to 2B - 1 words on (for B = 8 also nearer), are asked for:

* the suffix array of the words comes from prefix doubling, and the step that sorts by B words has each block's interval
  in it;
* a wavelet tree over the suffix array answers the range successor: the next occurrence behind a place in an interval;
* two occurrences that are no more than B / 2 apart begin a progression, whose end follows from one extension, so a
  window takes a few queries. Distances to its members are the candidate periods.

A candidate is extended both ways by the ranks of all doubling steps; stretches long enough are runs, and of candidates
with one stretch the smallest is its period. Everything runs over many documents at once, whose words are made different by
document, so nothing matches or extends across their ends; documents without an equal pair of blocks of 8 words go no
further than that step. A document is one row's work, linear up to logarithms in its words; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import map_batches, table

LEAST_LENGTH, LEAST_TIMES = 24, 3
FIRST = 3  # the smallest block has 2 ** FIRST words; 2 * 8 - 1 + 9 = LEAST_LENGTH covers the periods below it
#: Words that are searched at once; a longer document is searched on its own.
CHUNK = 1 << 16


class WaveletTree:
    """Range rank and range selection over an array of distinct numbers below ``len``, for many queries at once.

    Level by level, from the highest bit, numbers are parted by their bit, stably; ``ones`` counts the set bits before
    each place.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones: list[np.ndarray] = []
        now = values
        for b in range(self.bits - 1, -1, -1):
            bit = (now >> b) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.zeros = [len(values) - int(x[-1]) for x in self.ones]

    def successor(self, lo: np.ndarray, hi: np.ndarray, above: np.ndarray) -> np.ndarray:
        """The smallest number above ``above`` among the places lo to hi - 1; -1 where there is none."""
        n, wanted = len(self.ones[0]) - 1, above + 1
        # how many are smaller
        a, b, rank = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((wanted >> (self.bits - 1 - level)) & 1).astype(bool)
            oa, ob = ones[a], ones[b]
            rank += np.where(bit, (b - a) - (ob - oa), 0)
            a, b = np.where(bit, zeros + oa, a - oa), np.where(bit, zeros + ob, b - ob)
        rank[wanted >= n] = (hi - lo)[wanted >= n]
        # the one with that rank
        a, b, left, found = lo.copy(), hi.copy(), rank.copy(), np.zeros(len(lo), np.int64)
        none = rank >= hi - lo
        left[none] = 0
        for ones, zeros in zip(self.ones, self.zeros):
            oa, ob = ones[a], ones[b]
            clear = (b - a) - (ob - oa)
            bit = left >= clear
            left -= np.where(bit, clear, 0)
            found = found * 2 + bit
            a, b = np.where(bit, zeros + oa, a - oa), np.where(bit, zeros + ob, b - ob)
        found[none] = -1
        return found


def first_ranks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first word, rank of each suffix: the place where its group begins)."""
    order = np.argsort(words, kind="stable")
    sorted_ = words[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    rank = np.empty(len(words), np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, len(words)]))
    return order, rank


def doubled(order: np.ndarray, rank: np.ndarray, h: int, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank by 2 * h words from that by h words, and the places in the order that are still tied; ``order`` is sorted in place.

    ``tied`` are the places of groups with several suffixes; the others keep their ranks.
    """
    n = len(rank)
    suffixes = order[tied]
    ahead = suffixes + h
    nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
    own = rank[suffixes].astype(np.int64)
    key = own * (n + 1) + nxt + 1
    by = np.argsort(key, kind="stable")
    key, suffixes = key[by], suffixes[by]
    order[tied] = suffixes
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, len(key)])
    out = rank.copy()
    out[suffixes] = np.repeat(tied[at], size)
    return out, tied[np.repeat(size > 1, size)]


def tied_places(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    size = np.bincount(rank, minlength=len(rank))
    return np.flatnonzero(size[rank[order]] > 1)


class Text:
    """The words of several documents (numbers that differ by document), their suffix array and the ranks of each doubling step."""

    def __init__(self, words: np.ndarray):
        order, rank = first_ranks(words)
        self.ranks = [rank]
        tied = tied_places(order, rank)
        while len(tied):
            rank, tied = doubled(order, rank, 1 << (len(self.ranks) - 1), tied)
            self.ranks.append(rank)
        self.n, self.order = len(words), order
        self.tree = WaveletTree(order)

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words from x and y on (x < y)."""
        x, y, at = x.copy(), y.copy(), x
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (y < self.n) & (self.ranks[k][np.minimum(x, self.n - 1)] == self.ranks[k][np.minimum(y, self.n - 1)])
            x += same << k
            y += same << k
        return x - at

    def back(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words before x and y (x < y)."""
        x, y, at = x.copy(), y.copy(), x
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (x >= 1 << k) & (self.ranks[k][np.maximum(x - (1 << k), 0)] == self.ranks[k][np.maximum(y - (1 << k), 0)])
            x -= same << k
            y -= same << k
        return at - x

    def candidates(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of blocks of 2 ** k words, and distances to their occurrences in the neighbouring window."""
        block, rank = 1 << k, self.ranks[k]
        size = np.bincount(rank, minlength=self.n)
        at = np.arange(0, self.n, block)
        at = at[size[rank[at]] > 1]
        lo = rank[at].astype(np.int64)
        hi = lo + size[lo]
        far = at + 2 * block  # the window's end
        now = at + (block - 1 if k > FIRST else 0)
        places, distances = [], []
        while len(at):
            one = self.tree.successor(lo, hi, now)
            on = (one >= 0) & (one < far)
            at, lo, hi, far, one = at[on], lo[on], hi[on], far[on], one[on]
            two = self.tree.successor(lo, hi, one)
            step = two - one
            row = (two >= 0) & (2 * step <= block)
            # a progression: its end from the stretch with period ``step``
            step = np.where(row, step, 1)
            more = np.zeros(len(at), np.int64)
            if row.any():
                more[row] = (self.ahead(one[row], two[row]) + step[row] - block) // step[row]
            inside = np.minimum(more, (far - 1 - one) // step)
            count = inside + 1
            # members of the block's own progression have the period of its first
            own = row & (one - at <= block) & (self.ahead(at, at + step) + step >= one - at + block) if len(at) else row
            count[own] = 1 if k == FIRST else 0
            turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            places.append(np.repeat(at, count))
            distances.append(np.repeat(one - at, count) + turn * np.repeat(step, count))
            now = one + more * step
        return (np.concatenate(places), np.concatenate(distances)) if places else (np.empty(0, np.int64), np.empty(0, np.int64))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs, by start and period."""
        found = [np.empty((3, 0), np.int64)]
        for k in range(FIRST, len(self.ranks)):
            at, d = self.candidates(k)
            if not len(at):
                continue
            start, end = at - self.back(at, at + d), at + d + self.ahead(at, at + d)
            keep = (end - start >= LEAST_LENGTH) & (end - start >= LEAST_TIMES * d)
            found.append(np.stack([start[keep], end[keep], d[keep]]))
        start, end, d = np.concatenate(found, axis=1)
        order = np.lexsort((d, end, start))
        start, end, d = start[order], end[order], d[order]
        first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
        start, end, d = start[first], end[first], d[first]
        order = np.lexsort((d, start))
        return start[order], end[order], d[order]


def with_equal_blocks(words: np.ndarray) -> np.ndarray:
    """Whether each word lies in a group of equal stretches of 2 ** FIRST words that has several of them."""
    order, rank = first_ranks(words)
    tied = tied_places(order, rank)
    for k in range(FIRST):
        if not len(tied):
            break
        rank, tied = doubled(order, rank, 1 << k, tied)
    out = np.zeros(len(words), bool)
    out[order[tied]] = True
    return out


def runs_of(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period; a document is an array of word numbers."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]

    def joined(which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The words of some documents, made different by document, and where each document starts."""
        base, parts = 0, []
        for i in which:
            parts.append(docs[i] + base)
            base += int(docs[i].max()) + 1
        return np.concatenate(parts), np.cumsum([0] + [len(docs[i]) for i in which])

    def chunks(which: list[int]) -> Iterator[list[int]]:
        held, size = [], 0
        for i in which:
            if held and size + len(docs[i]) > CHUNK:
                yield held
                held, size = [], 0
            held.append(i)
            size += len(docs[i])
        if held:
            yield held

    open_: list[int] = []
    for which in chunks([i for i, d in enumerate(docs) if len(d) >= LEAST_LENGTH]):
        words, starts = joined(which)
        hit = np.add.reduceat(with_equal_blocks(words), starts[:-1])
        open_ += [i for i, x in zip(which, hit) if x]
    for which in chunks(open_):
        words, starts = joined(which)
        start, end, period = Text(words).runs()
        for j, s, e, q in zip((np.searchsorted(starts, start, "right") - 1).tolist(), start.tolist(), end.tolist(), period.tolist()):
            found[which[j]].append((s - int(starts[j]), e - s, q))
    return found


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are kept: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal words alike."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with most periods, ties by start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def planted(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each of ``n`` places of a document whose id has the hash ``h``; None if it is unchanged."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])


def find_runs(docs: DataFrame, planted_by: str | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and text (the words that are kept, joined by a space) of every row.

    ``planted_by``: a column with a hash by which periodic tails are planted first (``planted``); null plants nothing.
    A null or empty text has no words and no runs. A null id stays null. Of runs with one stretch the smallest period
    counts. Rows that repeat are searched alike and all stay; an empty table gives no rows, other columns are not read.
    Texts of any length are searched whole, each in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            held: list[tuple] = []
            size = 0
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                at = planted(len(words), hashes[i]) if hashes[i] is not None else None
                if at is not None:
                    words = [words[j] for j in at.tolist()]
                held.append((ids[i], words))
                size += len(words)
                if size >= 4 * CHUNK:
                    yield result(held)
                    held, size = [], 0
            if held:
                yield result(held)

    def result(held: list[tuple]) -> pa.RecordBatch:
        found = runs_of([numbered(words) for _, words in held])
        kept = []
        for (_, words), runs in zip(held, found):
            if runs:
                words = [words[j] for j in np.flatnonzero(collapsed(len(words), runs)).tolist()]
            kept.append(b" ".join(words).decode("utf-8"))
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([len(w) for _, w in held], pa.int64()), pa.array(rows, pa.list_(_RUN)), pa.array(kept, pa.string())], schema=_ARROW)

    mark = F.col(planted_by).cast("long") if planted_by else F.lit(None).cast("long")
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), mark), run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, periodic tails planted by the hash of its id; the first run is that with most periods."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    # the run with most periods, exactly: the product of lengths and periods fits, texts have fewer than 2**31 words
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    rows = find_runs(docs, "h").withColumn("best", F.aggregate("runs", none, longer))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
