import random
from collections import Counter, defaultdict

import pytest

from quarrymill.llm import common, neardup


def brute(rows, width):
    """Components by comparing all sets, through an inverted index of shingles."""
    sets, parent = [], {}
    for doc_id, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append((doc_id, set() if not words else {tuple(words)} if len(words) < width else set(zip(*(words[i:] for i in range(width))))))
        parent.setdefault(doc_id, doc_id)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, (doc_id, own) in enumerate(sets):
        met = Counter(j for s in own for j in index[s])
        for j, n in met.items():
            if 100 * n >= 80 * (len(own) + len(sets[j][1]) - n):
                a, b = sorted((find(doc_id), find(sets[j][0])))
                parent[b] = a
        for s in own:
            index[s].append(i)
    return {(d, len(s), find(d) if s else d) for d, s in sets}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_as_brute_force_on_documents(spark, small, width):
    assert got(neardup.near_duplicates(small, width)) == brute([(r.doc_id, r.text) for r in small.collect()], width)


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("block", [6, 1024])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    """Groups larger than a block, whose members link only partly: the drawn members, the main component and the rest."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(40):
            rows.append(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08, 0.15])))
        far = edited(rng, base, 0.12)
        rows += [edited(rng, far, rng.choice([0.01, 0.04])) for _ in range(15)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(docs, 2)) == brute(rows, 2)


def test_rows_of_hot_keys_stay(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(k, i) for k, n in ((1, 95), (2, 10), (3, 11), (4, 1), (6, 30)) for i in range(n)]
    big = spark.createDataFrame(rows, "post long, node long")
    hot = neardup.hot_keys(big.groupBy("post").count().withColumnRenamed("count", "n"), "post", len(rows))
    assert sorted(map(tuple, hot.collect())) == [(1, 95), (3, 11), (6, 30)]
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "e")], "post long, name string")
    got = neardup.split_join(big, one, "post", hot)
    assert got.columns == ["post", "node", "name"]
    assert Counter((r.post, r.node, r.name) for r in got.collect()) == Counter((k, i, "xabc"[k]) for k, i in rows if k < 4)


def test_groups_with_hot_keys_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06, 0.2])))) for i in range(90)] + [(100 + i, f"other text number {i} with words {i * 7}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(docs, 2)) == brute(rows, 2)


def test_edge_cases(spark, edge, empty):
    rows = neardup.near_duplicates(edge, 2).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[0].kept and by[2].component_id == 2
    assert by[3].n_shingles == 1 and by[5].component_id == by[6].component_id == 5 and by[5].kept and not by[6].kept
    assert neardup.near_duplicates(empty, 2).count() == 0
    one = neardup.keep_one(edge, 2)
    assert one.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(5) == 1 and 6 not in ids and {0, 1, 2, 3}.issubset(ids)
    assert neardup.keep_one(empty, 2).count() == 0


def test_rows_with_one_id_are_judged_each(spark, monkeypatch):
    """Different texts under one id, or none, stay; copies go, whatever ids they have."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    text = lambda i: " ".join(f"t{i}w{j}" for j in range(60))
    rows = [(7, text(i)) for i in range(30)] + [(7, text(0)), (7, text(1) + " more"), (None, text(2)), (None, text(40)), (None, text(40)), (3, text(4)), (9, text(41)), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in neardup.keep_one(docs, 5).collect())
    one = got.pop((7, text(1)), 0) + got.pop((7, text(1) + " more"), 0)
    want = Counter([(7, text(i)) for i in range(30) if i not in (1, 4)] + [(None, text(40)), (3, text(4)), (9, text(41)), (9, ""), (9, ""), (None, None)])
    assert one == 1 and got == want


@pytest.mark.parametrize("broadcast", [0, 10**9])
def test_one_family_of_many_members(spark, monkeypatch, broadcast):
    """One family far larger than a block and hot on every key: label, family, posting; drawn members broadcast or dealt by part."""
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BROADCAST_HASHES", broadcast)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(130)]
    rows, now = [], base
    for i in range(160):  # a chain whose ends don't link: far members are found only through others
        if i % 20 == 0:
            now = edited(rng, now, 0.03)
        rows.append((i, " ".join(edited(rng, now, 0.01))))
    rows += [(1000 + i, f"quite another text number {i} of {i * i} words") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(docs, 2)) == brute(rows, 2)


def test_left_split_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    big = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 2), (3, 5)) for i in range(n)], "label long, node long")
    one = spark.createDataFrame([(1, 10), (2, 20)], "label long, m long")
    assert Counter((r.label, r.m) for r in common.split_join(big, one, "label", how="left", total=16).collect()) == {(1, 10): 9, (2, 20): 2, (3, None): 5}


def test_signature_is_unbiased():
    rng = random.Random(1)
    common = [str(rng.random()) for _ in range(800)]
    a, b = (neardup.shingle_set(" ".join(common + [str(rng.random()) for _ in range(100)]), 1) for _ in range(2))
    agree = (neardup.signature(a, 1000) == neardup.signature(b, 1000)).mean()
    assert abs(agree - 0.8) < 0.05
