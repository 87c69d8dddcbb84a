"""Toxicity by maximal scoring segments over token log-odds.

Learning: the words of labelled documents, and the words' prefixes (languages inflect), are counted once a document in
either class; a feature's log-odds are smoothed by Dirichlet priors in proportion to its share of all documents, and it
is used if the likelihood ratio against no difference passes a bound that grows with the number of features tried, and
its log-odds are ``LEAST_ODDS`` or more. All other words score ``-DRIFT``.

Scoring: a word scores the largest log-odds among its features. One linear scan (the stack of Ruzzo and Tompa) finds all
maximal scoring segments of the whole text. In clean text the score of the best segment follows an extreme-value law:
a segment of score S in n words has lambda * S - ln(K * n) bits over chance, lambda and K from the clean documents
learned from. A document's best segment and the sum over its significant ones enter a logistic calibration to the label.

The model is fitted on at most about ``SAMPLE_DOCS`` labelled documents, drawn by hashes, and has every
feature of these that passes; every document is scored whole. Spark adds the sample up to sums, exact ones of integers,
so that reruns agree; to the driver go these, the features that pass, and counts of equal evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import crc_class, drawn, map_batches, slices, table, written

SAMPLE_DOCS = 20_000
PREFIXES = (4, 5, 6, 7, 8)
PRIOR = 20.0
LEAST_ODDS, DRIFT = 1.0, 0.25
UNIT = 1_000_000  # parts of a score or a logarithm in the sums
THRESHOLD = 0.7
_SIGNS = "".join(chr(i) for i in range(33, 128) if not chr(i).isalpha())


def features_of(word: str) -> list[str]:
    """A word (lower case, without signs at its ends) and its prefixes, these marked by a trailing *."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), given the positions and scores of the words above zero; others score -drift."""
    stack: list[list[float]] = []  # first, last, sum before the segment, sum after it
    total, at = 0.0, 0
    for pos, score in hits:
        total -= drift * (pos - at)
        first, before = pos, total
        total += score
        at = pos + 1
        item = [first, pos, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j -= 1
            if j < 0 or stack[j][3] >= item[3]:
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
        stack.append(item)
    return [(int(a), int(b), e - s) for a, b, s, e in stack]


class Scorer:
    """Word scores with a bounded memory of words met."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.met = odds, {}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        met, out = self.met, []
        if len(met) > 300_000:
            met.clear()
        for i, w in enumerate(words):
            s = met.get(w)
            if s is None:
                s = met[w] = max((self.odds.get(f, 0.0) for f in features_of(w.strip(_SIGNS))), default=0.0)
            if s:
                out.append((i, s))
        return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class by feature, added up within the task's batches."""
    for batch in batches:
        for part in slices(batch, 2048):
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = {w.strip(_SIGNS) for w in words_of(text or "")}
                words.discard("")
                count[toxic].update({f for w in words for f in features_of(w)})
                count[toxic][""] += 1
            for toxic, c in count.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([toxic] * len(c), pa.int64()), pa.array(c.values(), pa.int64())], names=["feature", "toxic", "n"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model, from documents and their labels (doc_id, toxic). Without both classes it scores all documents with the share of the label.

    Rows with a null label or id teach nothing, null texts count as empty. An id with both labels counts with each, label
    rows that repeat count once. Of documents that share an id each is labelled; ids are drawn by a hash, and what these
    bring beyond the bound is drawn again by id and text. Empty tables give a model that scores every document 0.5.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("d2"), F.col("toxic").cast("long").alias("toxic")).distinct()
    known = drawn(known, ["d2", "toxic"], sample_docs)
    joined = docs.join(known, F.col("doc_id") == F.col("d2")).select("doc_id", F.col("text").cast("string").alias("text"), "toxic")
    sample = drawn(written(joined, "labelled"), ["doc_id", "text", "toxic"], sample_docs).select("text", "toxic")
    count = map_batches(sample, _presence, "feature string, toxic long, n long").groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("y1"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("y0"))
    count = written(count, "features")
    whole = count.where("feature = ''").first()
    n1, n0 = (whole["y1"], whole["y0"]) if whole else (0, 0)
    model = {"odds": {}, "lam": 1.0, "log_k": 0.0, "weights": [0.0, 0.0, math.log((n1 + 0.5) / (n0 + 0.5))]}
    if not n1 or not n0:
        return model
    tried = count.count()
    y1, y0, share = F.col("y1"), F.col("y0"), n1 / (n1 + n0)
    both = y1 + y0
    part = lambda y, e: F.when(y > 0, y * F.log(y / e)).otherwise(0.0)
    ratio = 2 * (part(y1, both * share) + part(y0, both * (1 - share)))
    prior = PRIOR * both / (n1 + n0)
    odds = F.log((y1 + prior * share + 0.01) / (n1 + PRIOR * share)) - F.log((y0 + prior * (1 - share) + 0.01) / (n0 + PRIOR * (1 - share)))
    best = count.where("feature <> ''").withColumn("ratio", ratio).withColumn("odds", odds).where((F.col("ratio") >= 2 * math.log(tried) + 6) & (F.col("odds") >= LEAST_ODDS))
    model["odds"] = {r["feature"]: r["odds"] for r in best.select("feature", "odds").collect()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the clean documents of a batch: their number, words, hits, the hits' scores, best segments and logarithms of lengths."""
        scorer = Scorer(model["odds"])
        for batch in batches:
            out = [0] * 6
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not toxic:
                    words = words_of(text or "")
                    found = scorer.hits(words)
                    top = max((s for _, _, s in segments(found)), default=0.0)
                    for k, v in enumerate((1, len(words), len(found), sum(round(s * UNIT) for _, s in found), round(top * UNIT), round(math.log(max(len(words), 1)) * UNIT))):
                        out[k] += v
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in out], names=["docs", "words", "hits", "total", "best", "logs"])

    names = ("docs", "words", "hits", "total", "best", "logs")
    clean = map_batches(sample, sums, ", ".join(f"{x} long" for x in names)).agg(*[F.sum(x).alias(x) for x in names]).first()
    words, hits = clean["words"] + 1, clean["hits"] + 0.5
    mean = (clean["total"] / UNIT + 0.5 * 5) / hits
    lo, hi = 1e-3, 20.0
    for _ in range(80):  # the positive root of E exp(lambda * score) = 1
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if hits / words * math.exp(min(600, mid * mean)) + (1 - hits / words) * math.exp(-mid * DRIFT) < 1 else (lo, mid)
    model["lam"] = lo
    excess = (lo * clean["best"] - clean["logs"]) / UNIT / clean["docs"]
    model["log_k"] = float(np.clip(excess - 0.5772, -7, 0))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The evidence for each document, in thousandths, and its label."""
        scorer = Scorer(model["odds"])
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or "")
                rows.append((*(round(x * 1000) for x in evidence([s for _, _, s in segments(scorer.hits(words))], len(words), model)), toxic))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["one", "two", "toxic"])

    met = sorted(map(tuple, map_batches(sample, weigh, "one long, two long, toxic long").groupBy("one", "two", "toxic").agg(F.count("*").alias("n")).collect()))  # at most the sample's documents
    x, y = np.array([(a / 1000, b / 1000, 1.0) for a, b, _, _ in met]), np.array([float(t) for _, _, t, _ in met])
    n = np.array([float(k) for _, _, _, k in met])
    w = np.array(model["weights"])
    for _ in range(50):  # Newton steps of a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 1e-2 * w * [1, 1, 0]
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + np.diag([1e-2, 1e-2, 1e-6]), grad)
        w = w - np.clip(step, -2, 2)
    model["weights"] = w.tolist()
    return model


def evidence(scores: list[float], n: int, model: dict) -> tuple[float, float]:
    """Bits over chance of the best segment, and the logarithm of one plus the sum of those of all significant ones."""
    chance = model["log_k"] + math.log(max(n, 1))
    bits = [model["lam"] * s - chance for s in scores]
    best = max(bits, default=-chance if chance > 0 else 0.0)
    return float(np.clip(best, -20, 40)) / 10, math.log1p(sum(b for b in bits if b > 0))


def classify(docs: DataFrame, model: dict, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages (first and last word of each significant segment) of every row.

    A null text counts as empty and has the score of no evidence, as every text without a scoring word of its length
    has; a null id stays null and isn't held out. Of segments that score alike all are kept. Rows that repeat are scored
    alike and all stay; an empty table gives no rows, other columns are not read.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model["odds"])
        for batch in batches:
            for part in slices(batch):
                scores, where = [], []
                for t in part.column(2).to_pylist():
                    words = words_of(t or "")
                    found = segments(scorer.hits(words))
                    a, b = evidence([s for _, _, s in found], len(words), model)
                    z = a * model["weights"][0] + b * model["weights"][1] + model["weights"][2]
                    scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                    chance = model["log_k"] + math.log(max(len(words), 1))
                    where.append(",".join(f"{i}:{j}" for i, j, s in found if model["lam"] * s > chance))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(where, pa.string())], schema=arrow)

    return map_batches(docs.select(F.col(key).cast("long"), F.coalesce(held_out, F.lit(False)), F.col(text)), run, "doc_id long, held_out boolean, score double, predicted int, passages string")


def op8_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels of documents whose crc32(id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_class("doc_id", 3) != 1))
    return classify(docs, model, crc_class("doc_id", 3) == 1)
