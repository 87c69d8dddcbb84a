from collections import Counter

import pytest

from quarrymill.llm import sharding


def brute(names, size):
    """The published turn-taking, with each shard's whole permutation written out."""
    perms = [[(o + i * s) % size for i in range(size)] for o, s in (sharding.preference(n, size) for n in names)]
    owner = {}
    while True:
        for k, perm in enumerate(perms):
            slot = next(x for x in perm if x not in owner)
            owner[slot] = k
            if len(owner) == size:
                return [owner[i] for i in range(size)]


def test_as_brute_force():
    for n, size in [(1, 13), (3, 101), (7, 257), (13, 13)]:
        names = [f"n{i}" for i in range(n)]
        assert sharding.fill_table(names, size) == brute(names, size)


def test_even_and_steady():
    names = [f"n{i}" for i in range(20)]
    full, less = sharding.fill_table(names, 10_007), sharding.fill_table(names[:-1], 10_007)
    share = Counter(full).values()
    assert max(share) - min(share) <= 1
    moved = sum(a != b for a, b in zip(full, less) if a != 19)
    assert moved < 0.1 * 10_007


def test_bad_tables():
    for names, size in [([], 13), (["a", "a"], 13), (["a"], 12), (["a", "b", "c"], 2)]:
        with pytest.raises(ValueError):
            sharding.fill_table(names, size)


def test_query_covers_all_documents(spark, small):
    rows = sharding.op10_shard_documents(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in small.collect()} and len(rows) == small.count()
    table = sharding.fill_table([f"shard-{i:04d}" for i in range(sharding.SHARDS)])
    assert all(table[r.slot] == r.shard and r.shard_name == f"shard-{r.shard:04d}" for r in rows)


def test_edge_cases(spark, edge, empty, tmp_path):
    names = ["a", "b", "c"]
    rows = sharding.assign_shards(edge, "doc_id", names, 101).collect()
    assert len(rows) == edge.count()
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1 and all(r.shard_name in names for r in rows)
    assert sharding.assign_shards(empty, "doc_id", names, 101).count() == 0
    sharding.write_shards(edge.select("doc_id", "text"), str(tmp_path / "out"), "doc_id", names, 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == edge.count() and set(back.columns) == {"doc_id", "text", "shard_name"}
