"""Hybrid search: hard filters, a vector leg and a text leg, weighted reciprocal ranks, diversified order.

Each leg alone is a top-k order (TakeOrdered). The hybrid makes both scores in one pass over the candidates and ranks
narrow rows, so at most 2 * k rows are fused. Distances are built-in array functions, inside the JVM. The text leg
matches any query word; the hybrid counts the query words that a text holds, ``text_leg`` ranks by that count or by
BM25 over the filtered set, with a light stem if asked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.postings import Index, matches, terms
from quarrymill.operators.topk import cap_per_group, diversify

#: Fusion: weights of the legs and the constant of the reciprocal ranks; sizes of legs, cap a brand, rows returned. Fixed values.
W_VECTOR, W_TEXT, RANK_CONSTANT = 0.7, 0.3, 60
LEG, PER_BRAND, RETURNED = 60, 8, 50
#: Words that carry no meaning for matching; fixed values.
STOP_WORDS = frozenset("a an and are as at be by for from has have in is it of on or that the this to was were what with".split())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, query: list[float]) -> Column:
    """1 - cosine similarity; null for a null vector or one of length zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    return 1 - dot(a, q) / F.nullif(F.sqrt(dot(a, a)) * F.lit(norm), F.lit(0.0))


def vector_leg(df: DataFrame, vector: str, key: str, query: list[float], k: int = LEG, brand: str | None = None, per_brand: int = PER_BRAND) -> DataFrame:
    """The k nearest rows, at most ``per_brand`` of a brand if one is named; adds dist and rank_v (long)."""
    near = df.where(F.col(vector).isNotNull()).withColumn("dist", cosine_distance(F.col(vector), query))
    if brand:
        near = cap_per_group(near, [brand], [F.col("dist"), F.col(key)], per_brand, "__rn").drop("__rn")
    top = near.orderBy("dist", key).limit(k)
    return top.withColumn("rank_v", F.row_number().over(Window.orderBy("dist", key)).cast("long"))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def stem(token: Column) -> Column:
    """A light stem: plural and participle endings of longer words go."""
    t = F.regexp_replace(token, "(?<=[a-z]{3})ies$", "y")
    t = F.regexp_replace(t, "(?<=[a-z]{2}(?:s|x|z|ch|sh))es$", "")
    t = F.regexp_replace(t, "(?<=[a-z]{2}[^s])s$", "")
    return F.regexp_replace(t, "(?<=[a-z]{4})(?:ing|ed)$", "")


def query_terms(text: str) -> list[str]:
    """A query's distinct terms without stop words, in order."""
    raw = "".join(c if "a" <= c <= "z" else " " for c in text.lower()).split()
    return list(dict.fromkeys(t for t in raw if t not in STOP_WORDS))


def _times(words: Column, term: Column) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def _whole(term: str) -> str:
    """A pattern for the term as a whole run of letters of a lower-case text."""
    return f"(?<![a-z]){term}(?![a-z])"


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text holds; zero for a null text."""
    low = F.lower(text)
    return sum([F.coalesce(low.rlike(_whole(t)), F.lit(False)).cast("int") for t in terms], F.lit(0))


def text_leg(df: DataFrame, text: str, key: str, terms: list[str], k: int = LEG, bm25: bool = False, stemmed: bool = False) -> DataFrame:
    """The k rows that match best by any term; adds hits or the BM25 score as text_score, and rank_t (long). No terms, no rows.

    For BM25 the texts are read for the statistics of the set and again for the order, and the k rows found get their
    other columns back by key. Sets that are asked often have an index instead (``postings``), which spares both.
    """
    if not terms:
        return df.where(F.lit(False)).withColumn("text_score", F.lit(None).cast("double")).withColumn("rank_t", F.lit(None).cast("long"))
    order = Window.orderBy(F.desc("text_score"), key)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    if stemmed:
        words = F.transform(tokens(low), stem)
        times, length = [_times(words, stem(F.lit(t))) for t in terms], F.size(words)
    else:
        times, length = [F.regexp_count(low, F.lit(_whole(t))) for t in terms], F.regexp_count(low, F.lit("[a-z]+"))
    if not bm25:
        score = sum([(t > 0).cast("int") for t in times], F.lit(0)) if stemmed else hits(F.col(text), terms)
        top = df.withColumn("text_score", score.cast("double")).where("text_score > 0").orderBy(F.desc("text_score"), key).limit(k)
        return top.withColumn("rank_t", F.row_number().over(order).cast("long"))
    narrow = df.select(key, F.array(*times).alias("__tf"), length.alias("__n"))
    stats = narrow.agg(F.count("*").alias("docs"), F.avg("__n").alias("length"), *[F.count_if(F.col("__tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = narrow.where(F.array_max("__tf") > 0).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        f = F.col("__tf")[i]
        score = score + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("__n") / F.col("length")))
    top = rows.select(key, score.alias("text_score")).orderBy(F.desc("text_score"), key).limit(k)
    ranked = top.withColumn("rank_t", F.row_number().over(order).cast("long"))
    return ranked if df.columns == [key] else df.join(F.broadcast(ranked), key)


def fuse(vector: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """key, rank_v, rank_t, score: the weighted sum of reciprocal ranks over the union of the legs."""
    met = vector.select(key, "rank_v").join(text.select(key, "rank_t"), key, "full_outer")
    return met.withColumn("score", rrf())


def both_legs(candidates: DataFrame, key: str, vector: str, text: str, keep: list[str], brand: str, query: list[float], residual: str, k: int = LEG, per_brand: int = PER_BRAND, index: Index | None = None) -> DataFrame:
    """key, ``keep``, rank_v, rank_t of the rows that either leg finds, from one pass over the candidates.

    With an index the text leg is English full text: the candidates meet the scores of the query's postings and their texts
    aren't read. Without one a text's score is the number of query words that it holds.

    Each row gives up to two narrow rows, one a leg. They are cut in two steps, so that no task ranks a whole leg: first
    to ``per_brand`` of each brand (vector leg) or to k of each of 64 parts (text leg), then to k.
    """
    score = F.lit(0.0) if index else hits(F.col(text), query_terms(residual)).cast("double")
    scored = candidates.where(F.col(vector).isNotNull()).select(key, *keep, cosine_distance(F.col(vector), query).alias("__d"), score.alias("__h"), F.coalesce(F.col(brand).cast("string"), F.lit("")).alias("__b"))
    if index and terms(residual):
        scored = scored.drop("__h").join(matches(index, key, residual).select(key, F.col("text_score").alias("__h")), key, "left").withColumn("__h", F.coalesce("__h", F.lit(0.0)))
    entry = lambda leg, score, part: F.struct(F.lit(leg).alias("leg"), score.alias("score"), part.alias("part"))
    legs = F.array(entry("v", F.col("__d"), F.col("__b")), F.when(F.col("__h") > 0, entry("t", -F.col("__h"), F.pmod(F.xxhash64(key), F.lit(64)).cast("string"))))
    rows = scored.select(key, *keep, F.explode(F.array_compact(legs)).alias("__x")).select(key, *keep, "__x.*")
    order = [F.col("score").asc_nulls_last(), F.col(key)]
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("leg", "part").orderBy(*order))).where(F.col("__r") <= max(k, per_brand)).where((F.col("leg") == "t") | (F.col("__r") <= per_brand))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("leg").orderBy(*order)).cast("long")).where(F.col("__r") <= k)
    rank = lambda leg: F.max(F.when(F.col("leg") == leg, F.col("__r")))
    return rows.groupBy(key, *keep).agg(rank("v").alias("rank_v"), rank("t").alias("rank_t"))


def rrf(rank_v: str = "rank_v", rank_t: str = "rank_t") -> Column:
    """The weighted sum of reciprocal ranks; a leg that lacks the row adds nothing."""
    part = lambda w, r: F.coalesce(F.lit(w) / (RANK_CONSTANT + F.col(r)), F.lit(0.0))
    return part(W_VECTOR, rank_v) + part(W_TEXT, rank_t)


def hybrid(candidates: DataFrame, key: str, vector: str, text: str, category: str, brand: str, query: list[float], residual: str, returned: int = RETURNED, index: Index | None = None) -> DataFrame:
    """The fused, diversified answer with place from 1: key, category, brand, rank_v, rank_t, score, place.

    ``candidates`` are the rows behind the hard filters; rows without a vector aren't searched. Without terms in the
    residual text the text leg is left out.
    """
    named = both_legs(candidates, key, vector, text, [category, brand], brand, query, residual, index=index).withColumn("score", rrf())
    return diversify(named, category, brand, [F.desc("score"), F.col("rank_v").asc_nulls_last(), F.col("rank_t").asc_nulls_last(), F.col(key)], returned)


def fill_embeddings(df: DataFrame, key: str, text: str, vector: str, embed, batch: int = 100) -> DataFrame:
    """key and ``vector`` of the rows that lack one; ``embed`` turns a list of texts into vectors, a batch a call, on the executors."""

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield part[[key]].assign(**{vector: [list(map(float, v)) for v in embed(part[text].fillna("").tolist())]})

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(vector).isNull()).select(key, text).mapInPandas(run, f"{key} {kind}, {vector} array<float>")
