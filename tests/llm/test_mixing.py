import duckdb

from quarrymill.llm import mixing

SF = "/root/testdata/sf0.001"


def check(rows):
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.target, [0, 0, r.source_size])
        t[0] += r.taken
    return by


def test_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.OP5_SQL).fetchall())
    got = mixing.op5_mix_documents(spark, SF)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_sources_come_near_their_targets(spark, small):
    rows = mixing.mix(small).join(small.select("doc_id", "source"), "doc_id").collect()
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= max(2, 0.005 * target[s])


def test_excess_is_reshared(spark):
    rows = [(i, "w " * n, None, s, 0) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 1000), (None, 500)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[0].target == 30.0 and got[0].taken == 30  # stops at three times its size
    rest = 2510 - 30  # weights 2, 1 and, for null, 5 again
    # null's share would be 1550 of the rest, above its cap of 1500; b and c share what is left, 2 to 1
    assert got[3].target == 1500.0 and got[3].taken == 1500
    assert abs(got[1].target - (rest - 1500) * 2 / 3) < 1e-6 and abs(got[2].target - (rest - 1500) / 3) < 1e-6
    assert abs(sum(r.target for r in got.values()) - 2510) < 1e-6


def test_schedule_is_even(spark, small):
    targets = mixing.source_targets(mixing.measured(small)).cache()
    slots = mixing.schedule(targets).collect()
    total = len(slots)
    quota = {r.source: r.quota for r in targets.collect()}
    assert total == sum(quota.values())
    assert {(r.source, r.turn) for r in slots} == {(s, i) for s, q in quota.items() for i in range(q)}
    half = [r.source for r in slots if r.slot < total // 2]
    for s, q in quota.items():
        assert abs(half.count(s) - q / 2) <= 12


def test_any_run_of_slots_holds_the_target_shares(spark, small):
    targets = mixing.source_targets(mixing.measured(small)).cache()
    slots = sorted(mixing.schedule(targets).collect(), key=lambda r: r.slot)
    quota = {r.source: r.quota for r in targets.collect()}
    total = sum(quota.values())
    named = [r.source for r in slots if r.slot < 0.97 * total]  # the tail evens out what rounding left
    for width in (200, 1000):
        for at in range(0, len(named) - width, width // 2):
            run = named[at : at + width]
            for s, q in quota.items():
                assert abs(run.count(s) - width * q / total) <= 6


def test_rows_come_in_the_order_of_the_schedule(spark, small):
    """Any long run of the rows holds each source near its target share of the words; without the schedule it wouldn't."""
    target = {r.source: r.target for r in mixing.mix(small).join(small.select("doc_id", "source"), "doc_id").collect()}
    whole = sum(target.values())
    rows = [(r.source, len(r.text.encode().split())) for r in mixing.mix_rows(small).collect()]
    total = sum(n for _, n in rows)
    most = max(n for _, n in rows)
    held, at = {}, 0
    for s, n in rows:
        held[s] = held.get(s, 0) + n
        at += n
        for t, want in target.items():
            assert abs(held.get(t, 0) - at * want / whole) <= 2 * most + 0.03 * total
    assert abs(total - whole) <= 0.01 * whole + len(target)


def test_null_ids_are_not_id_zero(spark):
    """The same text under id 0 and under no id: each comes with its own id."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(0, text, "en", "a", 9), (None, text, "en", "a", 9), (1, text + " x", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    took = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    have = {}
    for r in mixing.mix_rows(docs).collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.split())
    assert have == {k: v for k, v in took.items() if v} and set(took) == {0, 1, None}


def test_many_sources_are_ordered_without_one_task(spark):
    """Places and cumulated quotas of sources that lie in many ranges are those of one sorted list."""
    rows = [(i, "w " * (5 + i % 7), "en", None if i % 311 == 0 else f"s{i % 97:02d}", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.source: r for r in mixing.source_targets(mixing.measured(docs)).collect()}
    names = sorted((x for x in got if x is not None)) + [None]
    so_far, slots = 0, sum(r.quota for r in got.values())
    for place, name in enumerate(names):
        r = got[name]
        assert r.lo == int(so_far / slots * 2**32) and r.hi == int((so_far + r.quota) / slots * 2**32)
        so_far += r.quota
        if r.target < 3 * r.source_size:
            assert abs(r.target / mixing.WEIGHTS[place % 3] - min(x.target / mixing.WEIGHTS[i % 3] for i, x in enumerate(got[n] for n in names) if x.target < 3 * x.source_size)) < 1e-6


def test_edge_cases(spark, edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(empty).count() == 0 and mixing.mix_rows(empty).count() == 0
    whole = mixing.mix_rows(edge)
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(len(r.text.split()) for r in whole.collect()) > 0
    blank = spark.createDataFrame([(1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)]


def test_rows_hold_what_the_mix_takes(spark, small):
    took = {r.doc_id: r.taken for r in mixing.mix(small).collect()}
    have = {}
    for r in mixing.mix_rows(small).collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.encode().split())
    # targets are those of one input, but for the hash that breaks ties between equal ids
    assert have == {k: v for k, v in took.items() if v}


def test_repeated_rows(spark, tmp_path):
    """Rows that repeat, null ids included, are mixed each for itself."""
    rows = [(7, "w " * 40, "en", "a", 80)] * 5 + [(None, "x y " * 30, "en", "a", 120)] * 4 + [(i, "z " * (20 + i), "en", "ab"[i % 2], 0) for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    got = mixing.mix(docs).collect()
    check(got)
    key = lambda r: tuple((v is None, v) for v in r)
    columns = ("doc_id", "size", "source_size", "target", "taken", "first_slot")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(con.sql(mixing.OP5_SQL).fetchall(), key=key)
    took, have = {}, {}
    for r in got:
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
    parts = mixing.mix_rows(docs).collect()
    for r in parts:
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.split())
    assert have == {k: v for k, v in took.items() if v}
    for i in (7, None):
        assert sum(r.doc_id == i for r in parts) >= sum(r.taken > 0 for r in got if r.doc_id == i) > 1


def test_many_sources_as_sql(spark, tmp_path):
    """More sources than the join's cells can part evenly: quotas, slots and blocks are those of SQL."""
    rows = [(i, "w " * (1 + i * 7 % 37), "en", f"s{i % 300:03d}" if i % 11 else None, 0) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in mixing.op5_mix_documents(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(mixing.OP5_SQL).fetchall())
