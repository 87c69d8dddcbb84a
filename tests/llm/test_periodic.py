import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarrymill.llm import periodic as p


def brute_runs(words):
    """Every maximal stretch of every period, the smallest period of each stretch; quadratic."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)  # periods ascend
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


def brute_row(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def shapes(rng):
    """Word sequences with nested, adjoining and overlapping repetitions over small alphabets."""
    n = rng.randrange(0, 300)
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    if kind == 1:  # powers of powers
        w = [rng.randrange(2) for _ in range(rng.randrange(1, 6))]
        while len(w) < n:
            w = w * rng.randrange(1, 5) + [rng.randrange(3) for _ in range(rng.randrange(3))]
        return w
    if kind == 2:  # Fibonacci words hold many runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        out = []
        while len(out) < n:
            out += [rng.randrange(5) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 8)
        return out
    if kind == 4:  # long stretches of one word, broken
        return [int(rng.random() < 0.03) for _ in range(n)]
    return ([0] * rng.randrange(60) + [1]) * rng.randrange(1, 8) + [0] * rng.randrange(60)


def test_runs_equal_brute_force():
    rng = random.Random(7)
    docs = [shapes(rng) for _ in range(1500)]
    got = p.runs_of([np.array(d, np.int64) for d in docs])
    for d, runs in zip(docs, got):
        assert runs == brute_runs(d), d
    assert sum(map(len, got)) > 1000


def test_long_documents_alone_equal_together(monkeypatch):
    rng = random.Random(8)
    docs = [np.array(shapes(rng) * 3, np.int64) for _ in range(60)]
    want = p.runs_of(docs)
    monkeypatch.setattr(p, "CHUNK", 50)
    assert p.runs_of(docs) == want == [brute_runs(d.tolist()) for d in docs]


def test_wavelet_tree_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 9, 100):
        values = rng.permutation(n)
        tree = p.WaveletTree(values)
        lo = rng.integers(0, n, 300)
        hi = np.array([rng.integers(x + 1, n + 1) for x in lo])
        above = rng.integers(-1, n, 300)
        want = [min((int(v) for v in values[a:b] if v > c), default=-1) for a, b, c in zip(lo, hi, above)]
        assert tree.successor(lo, hi, above).tolist() == want


def test_many_words_in_time():
    """One word 300,000 times, and long periods: near linear work."""
    n = 300_000
    assert p.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    word = np.arange(n // 4)
    assert p.runs_of([np.tile(word, 4)]) == [[(0, n // 4 * 4, n // 4)]]
    assert p.runs_of([np.arange(n)]) == [[]]


def test_all_documents_as_by_hand(spark, small):
    got = {r.doc_id: tuple(r) for r in p.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect() if len(r.text.split()) < 1500]
    for doc_id, text in rows:
        assert got[doc_id] == brute_row(doc_id, text)
    assert len(got) == small.count() and sum(got[i][1] > 0 for i, _ in rows) > 5


def test_edge_rows(spark, edge, empty, tmp_path):
    def result(rows):
        return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in p.find_runs(rows).collect()), key=repr)

    got = result(edge)
    assert len(got) == edge.count()
    for r in edge.collect():
        words = (r.text or "").split()
        if len(words) < 1000:
            assert (r.doc_id, len(words), [], " ".join(words)) in got or brute_runs(words)
    assert p.find_runs(empty).count() == 0
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    rows = p.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == edge.count() and all(r.runs_sha256 and r.collapsed_sha256 for r in rows)
    want = sorted((brute_row(r.doc_id, r.text) for r in edge.collect() if len((r.text or "").split()) < 1000), key=repr)
    assert sorted((tuple(r) for r in rows if tuple(r) in want), key=repr) == want


@pytest.mark.parametrize("runs,want", [([(0, 30, 10), (5, 24, 8), (9, 33, 11)], (0, 30, 10)), ([(3, 24, 3), (1, 40, 5)], (1, 40, 5))])
def test_best_run(runs, want):
    assert p.best_run(runs) == want
