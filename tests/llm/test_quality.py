import random

import duckdb
import pytest

from quarrymill.llm import quality

SF = "/root/testdata/sf0.001"


def naive(text):
    text = text or ""
    words = [w for w in text.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines, dup, seen = [x for x in text.split("\n") if x.encode().split()], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines), sum("A" <= c <= "Z" for c in text)


def test_counts_as_naive():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\n", "#", "A", "\t", "\x0b", " "]) for _ in range(rng.randrange(80)))
        assert quality.counts(text) == naive(text)
    assert quality.counts(None) == (0,) * 7


def test_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(quality.OP2_SQL)
    got = quality.op2_quality_rules(spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_sketches_merge_and_err_little(spark):
    rng = random.Random(6)
    values = [int(rng.expovariate(0.002)) for _ in range(3000)]
    rows = spark.createDataFrame([("en", f"s{i % 3}", "r", v) for i, v in enumerate(values)], "lang string, source string, rule string, value long")
    sketch = rows.select("lang", "source", "rule", quality.bucket(rows.value).alias("bucket")).groupBy("lang", "source", "rule", "bucket").count().withColumnRenamed("count", "n")
    got = quality.quantiles(quality.merge(sketch, "lang"), "lang").first()
    for q, value in ((0.25, got.q1), (0.75, got.q3)):
        exact = sorted(values)[int(len(values) * q) - 1]
        assert exact * (1 - 1 / 32) - 1 <= value <= exact


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def styled(rng, size, symbols=0.0, capitals=0.0, dup_lines=0.0, repeats=0.0, letters=0):
    """A text of ``size`` words, in which shares of words have a symbol, a capital or stand in a repeated run, and of lines repeat."""
    words = []
    while len(words) < size:
        if words and rng.random() < repeats and len(words) > 8:
            at = rng.randrange(len(words) - 4)
            words += words[at : at + 4]
            continue
        w = rng.choice(WORDS) + "x" * letters + str(rng.randrange(10**6))
        w = w.capitalize() if rng.random() < capitals else w
        words.append(w + "$" if rng.random() < symbols else w)
    lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    for i in range(1, len(lines)):
        if rng.random() < dup_lines:
            lines[i] = lines[i - 1]
    return "\n".join(lines)


def test_all_thresholds_differ_between_unlike_groups(spark):
    """Plain prose and a source of tables: each of the five rules stands elsewhere, none at a number of its own."""
    rng = random.Random(8)
    plain = [styled(rng, rng.randrange(80, 300), 0.002, 0.05) for _ in range(300)]
    loud = [styled(rng, rng.randrange(80, 300), 0.3, 0.5, 0.15, 0.03, 6) for _ in range(300)]
    rows = [(i, t, "en", "plain" if i < 300 else "loud", 0) for i, t in enumerate(plain + loud)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.source: r for r in quality.thresholds(quality.sketches(quality.measure(docs))).collect()}
    for rule in quality.RULES:
        low, high = sorted(got[s][f"hi_{rule}"] for s in ("plain", "loud"))
        assert high > 1.2 * low, rule
    assert got["loud"].lo_word_length > 1.2 * got["plain"].lo_word_length
    # the fences are those of exact quartiles, within the sketch's error
    for source, texts in (("plain", plain), ("loud", loud)):
        odds = sorted((c[2] + 1) * 10**6 / (c[1] + 1 - c[2]) for c in map(quality.counts, texts))
        q1, q3 = odds[len(odds) // 4 - 1], odds[len(odds) * 3 // 4 - 1]
        assert 0.9 < got[source].hi_symbols / (q3 * (q3 / q1) ** 2) < 1.2


def test_thresholds_follow_their_group(spark):
    """A source whose documents are all symbol-rich keeps them; the odd one in a plain source goes, one symbol alone doesn't decide."""
    rng = random.Random(9)
    rows = [(i, styled(rng, rng.randrange(80, 300)), "en", "plain", 0) for i in range(300)]
    rows += [(1000 + i, styled(rng, rng.randrange(80, 300), 0.5), "en", "tables", 0) for i in range(300)]
    rows += [(5000, styled(rng, 200, 0.6), "en", "plain", 0), (5001, styled(rng, 55) + " 5$", "en", "plain", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.kept for r in quality.assess(docs).collect()}
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(300)) and not kept[5000] and kept[5001]


def test_small_groups_use_the_merged_sketches(spark):
    rng = random.Random(10)
    rows = [(i, styled(rng, 90, 0.1), "en", "large", 0) for i in range(300)]
    rows += [(1000 + i, styled(rng, 90, 0.9), "en", "small", 0) for i in range(5)] + [(2000 + i, styled(rng, 90), "fr", "rare", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sketch = quality.sketches(quality.measure(docs))
    got = {r.source: r for r in quality.thresholds(sketch).collect()}
    of_all, of_en = quality.quantiles(quality.merge(sketch)), quality.quantiles(quality.merge(sketch, "lang"), "lang").where("lang = 'en'")
    for source, q in (("small", of_en), ("rare", of_all)):
        r = q.where("rule = 'symbols'").first()
        top = r.q3 + (1 << max(r.q3.bit_length() - 6, 0)) - 1
        assert abs(got[source].hi_symbols - top * (top / r.q1) ** 2) < 1e-6 * got[source].hi_symbols


def test_labelled_documents(spark):
    """No document with a good label goes but by the base rules (one in two hundred allowed), and all with a bad one go."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = quality.op2_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert len(good) > 200 and sum(not r.kept for r in good) <= len(good) / 200 + 1
    assert bad and sum(r.kept for r in bad) <= len(bad) * 0.02


def test_edge_cases(spark, edge, empty):
    rows = quality.assess(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].base_failed and by[0].n_words == 0 and not by[2].kept and by[7].n_words == 36_000
    assert quality.assess(empty).count() == 0 and quality.keep_good(empty).count() == 0
    good = quality.keep_good(edge)
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert good.count() == sum(r.kept for r in rows)


@pytest.mark.parametrize("value", [0, 1, 63, 64, 65, 127, 1000, 9999, 10_000])
def test_bucket(spark, value):
    got = spark.createDataFrame([(value,)], "v long").select(quality.bucket(__import__("pyspark.sql.functions", fromlist=["col"]).col("v"))).first()[0]
    assert got <= value and value - got <= value / 32
    top = spark.createDataFrame([(got,)], "v long").select(quality.edge(__import__("pyspark.sql.functions", fromlist=["col"]).col("v"))).first()[0]
    assert value <= top <= max(got * 33 / 32, got)
