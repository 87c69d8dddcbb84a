import math
import random
import re
from collections import Counter

import numpy as np

from quarrymill.llm import ranked as r

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    """The contract word by word; rows (item, rank, doc, score)."""
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, seen, _ in held for t in seen)
    out = []
    for item, text in items:
        asked = terms(text)
        scored = []
        for i, seen, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * seen[t]) // (1000 * seen[t] + 12 * m)) for t in asked if t in seen)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in df.collect()), key=repr)


def test_terms():
    for text in ("A b-C3 é!ÀÉ ßx\x00y z\x7f_1 Iİ 你好,x", "", None, "  ", "x" * 1000):
        assert [t.decode() for t in r.terms_of(text)] == terms(text)


def test_all_documents_as_by_hand(spark, small):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = result(r.op11_ranked_search(spark, "/root/testdata/sf0.001"))
    assert got == brute([(x.doc_id, x.text) for x in small.select("doc_id", "text").collect()], [(x.item_id, x.text) for x in items.collect()])


def corpus(rng, n):
    """Frequent and rare words, ties and copies."""
    words = [f"w{i}" for i in range(400)]
    odds = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.choice([1, 3, 20, 80])))) for i in range(n)]
    return docs + [(n + i, docs[i % 7][1]) for i in range(n // 4)], [(q, " ".join(rng.choices(words, odds, k=rng.choice([1, 2, 6, 25])) + [rng.choice(words)] * (q % 4))) for q in range(60)]


def test_every_way_of_the_search(spark, monkeypatch):
    """Small shards and windows, all lists short, all long, both; several blocks of items: always the brute force."""
    rng = random.Random(3)
    docs, items = corpus(rng, 700)
    want = brute(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert result(r.search(d, q)) == want
    assert result(r.search(d, q, block_bytes=900)) == want


def test_shards_by_hand(monkeypatch):
    rng = random.Random(4)
    docs, items = corpus(rng, 900)
    numbers = {t: i for i, t in enumerate(sorted({t for _, x in items for t in terms(x)}))}
    held = [(i, Counter(terms(x)), len(terms(x))) for i, x in docs]
    n, total = len(held), sum(m for _, _, m in held)
    df = Counter(t for _, seen, _ in held for t in seen)
    want = brute(docs, items)
    for short, window, size in ((16, 512, 5000), (1, 7, 200), (10_000, 16, 300), (4, 1, 64)):
        monkeypatch.setattr(r, "SHORT", short)
        monkeypatch.setattr(r, "WINDOW", window)
        best = [r.Best(20) for _ in items]
        for a in range(0, n, size):
            part = held[a : a + size]
            own = [[(numbers[t], c) for t, c in seen.items() if t in numbers] for _, seen, _ in part]
            flat = [x for o in own for x in o]
            shard = r.Shard(np.array([i for i, _, _ in part]), np.array([m for _, _, m in part]), np.array(list(map(len, own))), np.array([t for t, _ in flat], np.int32), np.array([c for _, c in flat], np.int32), n, total, len(numbers))
            for (_, text), b in zip(items, best):
                asked = Counter(terms(text))
                shard.search(np.array([numbers[t] for t in asked]), np.array([r.weight(n, df[t]) * c for t, c in asked.items()], dtype=np.int64), b)
        got = [(item, k, int(i), int(s)) for (item, _), b in zip(items, best) for k, (i, s) in enumerate(zip(b.doc, b.score), 1)]
        assert sorted(got, key=repr) == want


def test_windows_out_of_reach_are_not_read(monkeypatch):
    """With a bar that only the first window reaches, no other is looked at."""
    n = 4096
    tfs = np.r_[np.full(64, 50), np.ones(n - 64)].astype(np.int32)
    shard = r.Shard(np.arange(n), np.full(n, 60), np.ones(n, int), np.zeros(n, np.int32), tfs, n, n * 60, 1)
    best, looked = r.Best(20), []
    add = r.Best.add
    monkeypatch.setattr(r.Best, "add", lambda self, score, doc: (looked.append(int(doc[0])), add(self, score, doc)))
    shard.search(np.array([0]), np.array([5]), best)
    assert looked == [0] and best.doc.tolist() == list(range(20))


def test_edge_rows(spark, edge, empty):
    items = [(1, "the lazy dog"), (1, "the lazy dog"), (1, "word5 other7"), (None, "no id here"), (2, None), (3, ""), (4, "--"), (5, "Äöü ß 你好")]
    q = spark.createDataFrame([(*x, "c", 9) for x in items], "item_id long, text string, doc_id string, rank int")
    rows = [(x.doc_id, x.text) for x in edge.select("doc_id", "text").collect()]
    assert result(r.search(edge, q)) == brute(rows, sorted({x for x in items if x[1]}, key=repr))
    assert r.search(empty, q).count() == 0 and r.search(edge, q.limit(0)).count() == 0
