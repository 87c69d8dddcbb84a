"""Every registered query of the catalog against its oracle, on the smallest tables."""

from itertools import permutations

import duckdb
import pytest

from quarrymill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", [n for n in registry.queries() if n in registry.oracle_sql()])
def test_as_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_lateral_order_is_total(spark):
    """Query and SQL name the same variant of those at one price: the order ends with the whole key of a variant."""
    order = "order by l_extendedprice asc nulls last, l_orderkey, l_suppkey, l_linenumber limit 1"
    assert order in registry.oracle_sql()["lateral_top1"]
    plan = registry.queries()["lateral_top1"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.split("\n") if "row_number()" in x)
    assert all(f"{c}#" in window for c in ("l_extendedprice", "l_orderkey", "l_suppkey", "l_linenumber"))


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """A folder of 120 texts that hold the words asked 1 to 5 times each, every one in another order, so all match alike; half have an embedding."""
    folder = str(tmp_path_factory.mktemp("tied"))
    words = ["tions", "annd", "therings", "ation", "inge"]
    texts = [(i, " ".join(w for w, n in zip(words, times) for _ in range(n)), "en", 400) for i, times in enumerate(permutations(range(1, 6)))]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [float((i * j) % 7 + 1) for j in range(64)], i % 10) for i in range(0, 120, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def both(spark, folder, name):
    """The rows of a query and of its SQL, by column, in their order by key."""
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, folder)
    found = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]}) order by doc_id").fetchall()
    return [tuple(r) for r in df.orderBy("doc_id").collect()], found


def test_hybrid_search_ties(spark, tied):
    """Texts that match alike tie in the query and in its SQL: the text leg ranks them by key."""
    got, want = both(spark, tied, "hybrid_search")
    assert got == want and len(got) == 50
    assert all(rank_t == doc_id // 2 + 1 for rows in (got, want) for doc_id, _, rank_t, _ in rows)


def test_text_density_ties(spark, tied):
    """The same for the text leg alone: the first 60 of 120 texts that match alike are those of the smallest keys, in their order."""
    got, want = both(spark, tied, "text_density_topk")
    assert got == want
    assert [(doc_id, rank_t) for doc_id, _, rank_t in want] == [(i, i + 1) for i in range(60)]
    assert len({score for _, score, _ in want}) == 1


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
