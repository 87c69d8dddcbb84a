"""The stemmer against published examples, and the postings table, its ranks and its searches against plain Python."""

import math
import re
from collections import Counter

import pytest

from quarrymill.functions.stemming import STOP_WORDS, stem
from quarrymill.operators import postings, search

#: Examples of the published algorithm, word and stem.
PUBLISHED = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz
failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci
hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization
vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti
formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic
gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
""".split()


def test_published_stems():
    assert [(a, stem(a)) for a in PUBLISHED[::2]] == list(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    assert stem("y") == "y" and stem("yy") == "yy" and stem("élan") == "élan" and stem("12s") == "12"


def test_query_terms():
    assert postings.terms("The Dogs were walking, and a DOG walked") == ["dog", "walk"]
    assert postings.terms("of the and") == [] and postings.terms("") == []


ROWS = [(1, "The dog walks. The dogs walked"), (2, "walking"), (3, "a cat and a dog"), (4, None), (5, ""), (6, "of the"), (7, "Katze läuft dog dog dog dog dog dog")]


def held(text):
    return Counter(stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in STOP_WORDS)


def bm25(rows, asked):
    each = {k: held(t) for k, t in rows}
    mean = sum(sum(c.values()) for c in each.values()) / len(each)
    out = {}
    for t in asked:
        df = sum(t in c for c in each.values())
        for k, c in each.items():
            if t in c:
                out[k] = out.get(k, 0) + math.log(1 + (len(each) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return out


def density(rows, asked):
    out = {k: sum(0.1 / 1.64493406685 * sum(1 / i**2 for i in range(1, c[t] + 1)) for t in asked) / len(asked) for k, c in ((k, held(t)) for k, t in rows)}
    return {k: v for k, v in out.items() if v}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, "x", [1]) for r in ROWS], "id long, t string, term string, positions array<int>")  # names that clash


def test_postings_by_hand(spark, rows, tmp_path):
    got = {(r.term, r.id): r.positions for r in postings.postings(rows, "id", "t").collect()}
    assert got["dog", 1] == [2, 5] and got["walk", 1] == [3, 6] and got["dog", 3] == [5] and got["läuft", 7] == [2]
    assert {k for _, k in got} == {1, 2, 3, 7}
    index = postings.write_index(rows, "id", "t", f"file://{tmp_path}/a")
    assert {r.id: r.n for r in index.sizes.collect()} == {1: 4, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0, 7: 8}
    for rank, brute in (("bm25", bm25), ("density", density)):
        got = {r.id: r.text_score for r in postings.matches(index, "id", "walked dogs", rank).collect()}
        want = brute(ROWS, ["walk", "dog"])
        assert set(got) == set(want) and all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())
    top = postings.indexed_leg(index, "id", "walked dogs", 2, within=rows.where("id <> 1")).orderBy("rank_t").collect()
    assert [(r.id, r.rank_t) for r in top] == [(7, 1), (2, 2)]
    assert postings.matches(index, "id", "of the").count() == 0
    with pytest.raises(ValueError):
        postings.matches(index, "id", "dog", "other")
    none = postings.write_index(rows.limit(0), "id", "t", f"file://{tmp_path}/b")
    assert postings.matches(none, "id", "dog", "bm25").count() == 0


def test_a_search_reads_its_terms_alone(spark, tmp_path):
    """Only files whose terms may be asked for are read beyond their footers, and no text."""
    spark.range(4000).selectExpr("id", "concat_ws(' ', transform(sequence(0, 19), i -> concat(char(97 + cast(pmod(id * 7 + i * 3, 26) as int)), 'word', pmod(id * i, 97)))) as t").write.parquet(f"{tmp_path}/texts")
    files = spark.read.parquet(f"{tmp_path}/texts")
    index = postings.write_index(files, "id", "t", f"file://{tmp_path}/index")
    found = postings.matches(index, "id", "zword3")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [zword3])" in plan.replace("EqualTo(term,zword3)", "In(term, [zword3])") and "ReadSchema: struct<term:string,id:bigint,positions:array<int>>" in plan
    assert found.count() == files.where("array_contains(split(t, ' '), 'zword3')").count() > 0
    spans = index.postings.groupBy("_metadata.file_path").agg({"term": "min"}).count()
    inside = index.postings.groupBy("_metadata.file_path").agg({"term": "max", "*": "count"}).where("`max(term)` >= 'zword3'").count()
    assert inside < spans or spans == 1  # ranges: one file may hold the term


def test_index_is_written_once(spark, tmp_path, monkeypatch):
    """Found again while the files are the same; written anew when they change."""
    written = []
    real = postings.write_index
    monkeypatch.setattr(postings, "write_index", lambda *a: written.append(1) or real(*a))
    spark.createDataFrame(ROWS, "id long, t string").write.parquet(f"{tmp_path}/t")
    for _ in range(2):
        index = postings.index_of(spark.read.parquet(f"{tmp_path}/t"), "id", "t")
        assert postings.matches(index, "id", "cat").count() == 1
    assert len(written) == 1
    spark.createDataFrame([(9, "another cat")], "id long, t string").write.mode("append").parquet(f"{tmp_path}/t")
    index = postings.index_of(spark.read.parquet(f"{tmp_path}/t"), "id", "t")
    assert postings.matches(index, "id", "cats").count() == 2 and len(written) == 2


def test_hybrid_with_an_index(spark, tmp_path):
    """The text leg follows the density of the stemmed terms, not the number of words that match."""
    rows = spark.createDataFrame([(1, "dog", [1.0, 0.0], "a", "x"), (2, "dogs walking dog dog", [0.0, 1.0], "a", "y"), (3, "walk", [0.0, 1.0], "b", "x"), (4, "none", [1.0, 0.1], "b", "y"), (5, "dog", None, "b", "y")], "id long, t string, v array<float>, cat string, brand string")
    index = postings.write_index(rows, "id", "t", f"file://{tmp_path}/h")
    legs = {r.id: (r.rank_v, r.rank_t) for r in search.both_legs(rows, "id", "v", "t", ["cat"], "brand", [1.0, 0.0], "walked dogs", index=index).collect()}
    assert legs == {1: (1, 2), 2: (3, 1), 3: (4, 3), 4: (2, None)}
    bare = {r.id: r.rank_t for r in search.both_legs(rows, "id", "v", "t", ["cat"], "brand", [1.0, 0.0], "the", index=index).collect()}
    assert set(bare.values()) == {None}
    found = search.hybrid(rows, "id", "v", "t", "cat", "brand", [1.0, 0.0], "walked dogs", index=index).collect()
    assert {r.id for r in found} == {1, 2, 3, 4}


def test_equal_matches_tie(spark, tmp_path):
    """Parts that add up to one score in any order tie to the last bit, and the key decides; adding doubles in the order of a shuffle doesn't."""
    schema = "term string, id long, positions array<int>"
    times = dict(zip("abcdefgh", range(1, 9)))
    found = []
    for turn in range(3):  # the same texts, their postings in another order each
        order = [*list(times)[turn:], *list(times)[:turn]]
        rows = [(term, k, list(range(times[list(times)[(i + k) % 8]]))) for term in order for i, t in enumerate(times) if t == term for k in range(20)]
        sizes = spark.createDataFrame([(k, 36) for k in range(20)], "id long, n long")
        index = postings.Index(spark.createDataFrame(rows, schema).coalesce(1), sizes)
        found += [[(r.id, r.text_score) for r in postings.matches(index, "id", list(times), rank).orderBy("id").collect()] for rank in ("density", "bm25")]
    assert all(len({score for _, score in rows}) == 1 and len(rows) == 20 for rows in found)
    assert found[0] == found[2] == found[4] and found[1] == found[3] == found[5]


def test_a_stem_tries_few_suffixes(monkeypatch):
    """The long suffixes are looked for only in words that end in a last letter of theirs: an index stems each word that it meets."""
    from quarrymill.functions import stemming

    tried = []
    real = stemming._replaced
    monkeypatch.setattr(stemming, "_replaced", lambda word, *rest: tried.append(word) or real(word, *rest))
    assert [stemming.stem.__wrapped__(w) for w in ("drop", "yoghurt", "walking", "yy1")] == ["drop", "yoghurt", "walk", "yy1"] and tried == []
    assert stemming.stem.__wrapped__("relational") == "relat" and tried
