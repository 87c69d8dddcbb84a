"""Held-out accuracy and edge cases of the language and toxicity models, and the scan against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import common, langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op9_identify_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.96


def test_language_edge_cases(spark, edge, empty, small):
    model = langid.learn(small)
    rows = {r.doc_id: r for r in langid.classify(edge, model, F.col("doc_id") == 3).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0.0
    assert rows[3].held_out and not rows[4].held_out and not rows[None].held_out
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.classify(empty, model, F.col("doc_id") == 3).count() == 0 and langid.learn(empty) == []
    assert {r.lang_pred for r in langid.classify(small, [], F.col("doc_id") == 3).collect()} == {"und"}


def test_language_as_brute_force(spark, small):
    """The decision is that of the plain size of each block compressed after each dictionary, and the dictionaries are those of a plain draw."""
    import zstandard as z

    model = tuple(langid.learn(small))
    assert {x for x, _ in model} == {r.lang for r in small.select("lang").distinct().collect() if r.lang}
    assert [n for n, _ in model] == [r.lang for r in small.where("lang is not null and length(text) > 0").groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    rows = {r.doc_id: r for r in langid.classify(small, list(model), F.lit(False)).collect()}
    params = [z.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(d), source_size=langid.BLOCK, min_match=langid.MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0) for _, d in model]
    for d in small.collect():
        raw = "".join(c for c in d.text.lower() if ord(c) >= 128 or c.isalpha() or c in " \t\n\x0b\x0c\r").encode().translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256)))
        sums = []
        for p, (_, content) in zip(params, model):
            learned = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            sums.append(sum(len(z.ZstdCompressor(dict_data=learned, compression_params=p).compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK)))
        got = rows[d.doc_id]
        if any(c.isalpha() for c in d.text):
            assert got.lang_pred == model[sums.index(min(sums))][0]
            best, rest = min(sums), sorted(sums)[1]
            assert got.accepted == (rest - best >= langid.MARGIN * rest)
        else:
            assert got.lang_pred == "und"


def test_dictionaries_are_filled_by_whole_documents(spark):
    """No language is dropped, however many there are, and a dictionary is full but for less than one document."""
    rows = [(1000 * k + i, f"lang{k} word{i} " * (4 + i % 50), f"l{k:03d}") for k in range(300) for i in range(3)] + [(10**6 + i, f"mmm{i} some more words of it " * 60, "main") for i in range(400)] + [(None, "x", None), (1, None, "zz"), (2, "", "yy"), (5, "über " * 40_000, "long")]
    model = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert len(model) == 302 and all(model.values()) and len(model["long"]) <= langid.DICT_BYTES
    texts = {langid.fold(t) for _, t, x in rows if x == "main"}
    assert langid.DICT_BYTES - 1800 - 3 * 60 * 80 < len(model["main"]) <= langid.DICT_BYTES  # digits are dropped after the draw
    whole = b"mmm some more words of it " * 60
    assert texts == {whole} and model["main"] == b" ".join([whole] * (len(model["main"]) // len(whole)))


@pytest.mark.parametrize("doc_id", [1, None])
def test_language_with_repeated_ids(spark, doc_id):
    """One id, or none, on all rows, and one text on all rows of a language: every dictionary is filled."""
    rows = [(doc_id, f"{'the and of' if i % 2 else 'der und die'} word{i} " * 30, "en" if i % 2 else "de") for i in range(3000)] + [(doc_id, "la même phrase " * 20, "fr")] * 2000
    model = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=20_000))
    assert all(len(model[x]) > 12_000 for x in ("en", "de")) and model["fr"] == langid.fold("la même phrase " * 20)


@pytest.mark.parametrize("doc_id", [7, None])
def test_draw_with_repeated_ids(spark, doc_id):
    """About as many rows as wanted, whatever the ids; copies are drawn once."""
    rows = spark.range(4000).selectExpr(f"cast({doc_id if doc_id else 'null'} as long) as doc_id", "concat('text ', id) as text")
    assert 60 <= common.drawn(rows, ["doc_id", "text"], 100).count() <= 200
    copies = rows.selectExpr("doc_id", "'one text' as text")
    assert common.drawn(copies, ["doc_id", "text"], 100).count() == 1
    few = rows.selectExpr("doc_id", "concat('text ', pmod(hash(text), 150)) as text")
    got = common.drawn(few, ["doc_id", "text"], 100)
    assert got.columns == ["doc_id", "text"] and 75 <= got.count() <= 150 and got.distinct().count() == got.count()
    assert common.drawn(rows, ["doc_id", "text"], 2000).count() == 4000 and common.drawn(rows.limit(0), ["doc_id"], 5).count() == 0


def test_toxicity_with_repeated_ids(spark, small):
    """All documents under one id with both labels, more than the bound: the sample keeps it, and both classes are learned."""
    docs = small.selectExpr("1 as doc_id", "text")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (None, 1), (2, None)] * 50, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample_docs=50)
    assert model["odds"] == {} and 0 <= toxicity.classify(docs, model, F.lit(False)).first().score <= 1


def test_language_margin():
    model = (("xx", b"the cat and the dog and the bird " * 40), ("yy", b"der hund und die katze und der vogel " * 40))
    name, score, sure = langid.identify("the dog and the cat and the bird and the dog", model)
    assert name == "xx" and score > 0.5 and sure
    assert not langid.identify("zq", model)[2]


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.op8_score_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in rows if r.toxic == t] for t in (1, 0))
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.75 and sum(r.predicted for r in clean) / len(clean) < 0.03


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    return toxicity.train(docs, labels)


def test_toxicity_model_as_brute_force(spark, learned):
    """Counts, the test of features, their log-odds and the extreme-value law by plain Python over all labelled documents."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic in (0, 1)}
    rows = [(r.text or "", labels[r.doc_id]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in labels]
    count, n = {}, [0, 0]
    for text, toxic in rows:
        n[toxic] += 1
        for f in {f for x in text.lower().split() if (w := x.strip(toxicity._SIGNS)) for f in [w, *(w[:k] + "*" for k in toxicity.PREFIXES if len(w) >= k)]}:
            count.setdefault(f, [0, 0])[toxic] += 1
    share, odds = n[1] / sum(n), {}
    for f, (y0, y1) in count.items():
        both = y0 + y1
        ratio = 2 * ((y1 * math.log(y1 / (both * share)) if y1 else 0) + (y0 * math.log(y0 / (both * (1 - share))) if y0 else 0))
        prior = toxicity.PRIOR * both / sum(n)
        value = math.log((y1 + prior * share + 0.01) / (n[1] + toxicity.PRIOR * share)) - math.log((y0 + prior * (1 - share) + 0.01) / (n[0] + toxicity.PRIOR * (1 - share)))
        if ratio >= 2 * math.log(len(count) + 1) + 6 and value >= toxicity.LEAST_ODDS:
            odds[f] = value
    assert odds and set(odds) == set(learned["odds"]) and all(math.isclose(odds[f], v, rel_tol=1e-9) for f, v in learned["odds"].items())
    best, logs, words, hits, total = [], [], 0, 0, 0.0
    for text, toxic in rows:
        if not toxic:
            scores = [max((odds.get(f, 0.0) for f in toxicity.features_of(w.strip(toxicity._SIGNS)))) for w in text.lower().split()]
            words, hits, total = words + len(scores), hits + sum(s > 0 for s in scores), total + sum(scores)
            best.append(max((s for _, _, s in toxicity.segments([(i, s) for i, s in enumerate(scores) if s])), default=0.0))
            logs.append(math.log(max(len(scores), 1)))
    lam = learned["lam"]
    p, mean = (hits + 0.5) / (words + 1), (total + 2.5) / (hits + 0.5)
    assert abs(p * math.exp(lam * mean) + (1 - p) * math.exp(-lam * toxicity.DRIFT) - 1) < 1e-4
    assert abs(learned["log_k"] - min(0, max(-7, sum(lam * b - x for b, x in zip(best, logs)) / len(best) - 0.5772))) < 1e-4


def test_toxicity_edge_rows_meet_a_trained_model(spark, edge, learned):
    rows = toxicity.classify(edge, learned, F.col("doc_id") == 3).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == edge.count() and by[0].score == by[1].score == by[2].score and not by[0].passages and by[3].held_out and not by[None].held_out
    word = max((f for f in learned["odds"] if not f.endswith("*")), key=learned["odds"].get, default=None) or max(learned["odds"], key=learned["odds"].get).rstrip("*")
    far = f"{'clean words here ' * 20000}{(word + ' ') * 12}{'and on it goes ' * 20000}"
    docs = spark.createDataFrame([(1, far), (2, f"{(word + ' ') * 12}"), (2, f"{(word + ' ') * 12}"), (3, "clean words here")], "doc_id long, text string")
    got = toxicity.classify(docs, learned, F.lit(False)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 4 and by[2].score > by[3].score and by[1].passages == "60000:60011" and by[2].passages == "0:11"


def test_toxicity_edge_cases(spark, edge, empty, small):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (edge, empty):
        model = toxicity.train(docs, labels)
        rows = toxicity.classify(docs, model, F.col("doc_id") == 3).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def brute_segments(scores):
    """Every maximal segment: of the best remaining segments, the best first, disjoint from those before, none extendable (the recursive definition)."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[i : j + 1]), -i, -(j - i)) for i in range(len(scores)) for j in range(i, len(scores))))
    i = -best[1]
    j = i - best[2]
    left = brute_segments(scores[:i])
    right = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1 :])]
    return [*left, (i, j, best[0]), *right]


def test_scan_as_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        scores = [rng.choice([rng.uniform(0.1, 5), -0.25, -0.25, -0.25]) for _ in range(rng.randrange(1, 18))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.25)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want))
