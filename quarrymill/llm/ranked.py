"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time.

The terms of the items (the queries) are numbered, and each document becomes one narrow row: its length and how often it
holds each of these terms. That table is written; the number of documents, their total length and the documents of each
term are sums over it. Then each task searches its part of it for every item, shard by shard (an Arrow batch, bounded):

* the shard's postings are sorted by term, each list with its largest contribution and that of each window of documents;
* lists that are short beside the shard are taken term at a time: their contributions are summed into accumulators, which
  then are one list like the others, by document, with bounds of its own;
* this list and the long ones are walked document at a time, in windows. A window whose lists can't reach the score of the
  item's worst kept document is skipped. In the others the lists are ordered by bound: those that together can't reach
  that score make no candidates and are only looked up for documents that the rest leaves in reach.

A task keeps the best documents of each item over all its shards, so bounds get sharper as it goes, and hands over at most
``k`` a task and item; these are ranked at the end. Items come in blocks of about ``BLOCK_BYTES`` of text, each with its own
numbers and table, so neither the driver nor a task holds more; documents are never paired with items outside a task's search.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import map_batches, slices, table, written

TOP = 20
BLOCK_BYTES = 4_000_000
#: A list is short with fewer postings than one in ``SHORT`` of the shard's documents; documents of a window.
SHORT, WINDOW = 16, 512

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes: letters in lower case, digits and what isn't ASCII stay, all else is space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, Counter]]]:
    """Blocks of (item, its terms) of about ``block_bytes`` of text, drawn by a hash; rows that repeat are one item, items without terms give none."""
    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # block_bytes, or one item
        found = sorted((r["item"] is None, r["item"] or 0, r["text"]) for r in own)
        yield [(None if none else item, Counter(x)) for none, item, t in found if (x := terms_of(t))]


def counted(docs: DataFrame, numbers: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (its terms), terms and tfs (those of ``numbers`` that it holds, and how often) of each row that has a term."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, sizes, held, times = [], [], [], []
                for i, value in zip(part.column(0).to_pylist(), part.column(1)):
                    if found := terms_of(value.as_py()):
                        seen = Counter(found)
                        own = [x for x in seen if x in numbers]
                        ids.append(i), sizes.append(len(found)), held.append([numbers[x] for x in own]), times.append([seen[x] for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, sizes, held, times), arrow)], schema=arrow)

    return map_batches(docs.select(F.col(key).cast("long"), F.col(text).cast("string")), run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Best:
    """The ``k`` best (score, document) of an item so far; equal scores by ascending document."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self) -> int:
        """A document needs this score at least."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.r_[self.score, score], np.r_[self.doc, doc]
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class Postings:
    """One list: documents in order, contributions, the bound of the list and of each window."""

    def __init__(self, docs: np.ndarray, gives: np.ndarray, edges: np.ndarray):
        self.docs, self.gives, self.bound = docs, gives, int(gives.max())
        self.at = np.searchsorted(docs, edges)  # where each window begins
        self.window_bound = np.zeros(len(edges) - 1, np.int64)
        full = np.flatnonzero(np.diff(self.at))
        self.window_bound[full] = np.maximum.reduceat(gives, self.at[full])


class Shard:
    """The postings of some documents, sorted by term."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, docs: int, total: int, n_terms: int):
        self.doc_ids, self.n = doc_ids, len(doc_ids)
        m = 75 + 25 * lengths * docs // total
        owner, tf = np.repeat(np.arange(self.n), sizes), tfs.astype(np.int64)
        part = 1_000_000_000 * tf // (1000 * tf + 12 * m[owner])
        order = np.argsort(terms, kind="stable")
        self.docs, self.part = owner[order], part[order]
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.edges = np.r_[np.arange(0, self.n, WINDOW), self.n]

    def lists(self, wanted: np.ndarray, weights: np.ndarray) -> list[Postings]:
        """The accumulators of the short lists as one list, and the long lists, by bound."""
        short, out = [], []
        for t, w in zip(wanted.tolist(), weights.tolist()):
            i, j = int(self.start[t]), int(self.start[t + 1])
            if i < j and w:
                if (j - i) * SHORT < self.n:
                    short.append((self.docs[i:j], self.part[i:j] * w))
                else:
                    out.append(Postings(self.docs[i:j], self.part[i:j] * w, self.edges))
        if short:
            docs, gives = np.concatenate([x for x, _ in short]), np.concatenate([x for _, x in short])
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
            out.append(Postings(docs[at], np.add.reduceat(gives[order], at), self.edges))
        return sorted(out, key=lambda x: x.bound)

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the shard's documents that are among the best of an item."""
        lists = self.lists(wanted, weights)
        if not lists:
            return
        upto = np.cumsum([x.bound for x in lists])  # what the lists up to each can give together
        reach = np.sum([x.window_bound for x in lists], axis=0)
        for w in np.flatnonzero(reach >= best.bar).tolist():
            bar = best.bar
            if reach[w] < bar:
                continue
            first = int(np.searchsorted(upto, bar))  # lists before it together stay below the bar
            if first == len(lists):
                return
            base = int(self.edges[w])
            score = np.zeros(int(self.edges[w + 1]) - base, np.int64)
            for x in lists[first:]:
                i, j = x.at[w], x.at[w + 1]
                score[x.docs[i:j] - base] += x.gives[i:j]
            found = np.flatnonzero(score)
            for k in range(first - 1, -1, -1):
                found = found[score[found] + int(upto[k]) >= bar]
                if not len(found):
                    break
                x = lists[k]
                docs = x.docs[x.at[w] : x.at[w + 1]]
                at = np.searchsorted(docs, found + base)
                hit = at < len(docs)
                hit[hit] = docs[at[hit]] == found[hit] + base
                score[found[hit]] += x.gives[x.at[w] + at[hit]]
            found = found[score[found] >= bar]
            if len(found):
                best.add(score[found], self.doc_ids[found + base])


NO_ID = np.iinfo(np.int64).max  # a null id, behind all others


def best_documents(rows: DataFrame, items: list[tuple[int, list[int], list[int]]], docs: int, total: int, n_terms: int, k: int) -> DataFrame:
    """item_id, turn (the item's place in ``items``), doc_id, score: the best of each task. An item is (id, terms, weights)."""
    arrow = pa.schema([("item_id", pa.int64()), ("turn", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(np.array(t), np.array(w, dtype=np.int64)) for _, t, w in items]
        best = [Best(k) for _ in items]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(order := np.argsort(ids, kind="stable")))  # documents in order
            lists = batch.column(2)
            shard = Shard(ids[order], batch.column(1).to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy(), docs, total, n_terms)
            for (t, w), own in zip(wanted, best):
                shard.search(t, w, own)
        held = [i for i, own in enumerate(best) for _ in own.doc]
        found = np.concatenate([own.doc for own in best] or [np.empty(0, np.int64)])
        score = np.concatenate([own.score for own in best] or [np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([items[i][0] for i in held], pa.int64()), pa.array(held, pa.int32()), pa.array(found, pa.int64(), mask=found == NO_ID), pa.array(score, pa.int64())], schema=arrow)

    return map_batches(rows, run, "item_id long, turn int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents with the highest scores above 0, equal scores by doc_id.

    A null or empty text has no terms: such a document doesn't count, such an item finds nothing. Rows of documents that
    repeat are documents of their own; a null id ranks behind all ids of its score. Rows of items with the same id and
    text are one item; with different texts each has a list of its own. Empty tables give no rows; other columns are not
    read. Texts of any length are read whole.
    """
    found = []
    for block in item_blocks(items, block_bytes=block_bytes):
        numbers = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        if not numbers:
            continue
        rows = written(counted(docs, numbers), "counted")
        n, total = rows.agg(F.count("*"), F.sum("n")).first()
        df = dict(map(tuple, rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))  # a row a term of the block
        weights = [weight(n, df.get(t, 0)) for t in range(len(numbers))]
        asked = [(item, [numbers[t] for t in own], [weights[numbers[t]] * times for t, times in own.items()]) for item, own in block]
        part = best_documents(rows, asked, n, total or 1, len(numbers), k)
        order = Window.partitionBy("turn").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') as terms from documents),
asked as (select row_number() over () as iid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') as terms from (select distinct item_id, text from benchmark where text is not null)),
sizes as (select count(*)::bigint as n_docs, sum(len(terms))::bigint as total from docs where len(terms) > 0),
wanted as (select iid, term, count(*)::bigint as times from (select iid, unnest(terms) as term from asked) group by iid, term),
held as (select rid, term, count(*)::bigint as tf from (select rid, unnest(terms) as term from docs) where term in (select term from wanted) group by rid, term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from held group by term), sizes),
norms as (select rid, doc_id, 75 + (25 * len(terms)::bigint * n_docs) // total as m from docs, sizes),
scores as (select iid, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from wanted join weights using (term) join held using (term) join norms using (rid) group by iid, rid),
ranked as (select iid, n.doc_id, score, row_number() over (partition by iid order by score desc, n.doc_id nulls last) as rank from scores s join norms n using (rid) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked join asked using (iid) where rank <= {TOP}
"""
