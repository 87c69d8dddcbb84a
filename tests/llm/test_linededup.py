import hashlib
from collections import defaultdict

import pytest

from quarrymill.llm import common
from quarrymill.llm import linededup as d

LINE = "a line that many of these documents share, word by word"
WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, least_chars=d.LEAST_CHARS, least_docs=d.LEAST_DOCS):
    """The contract word by word: (doc_id, n_lines, n_dropped, sha256) of each row."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(k := key(x)) >= least_chars and len(holders[k]) >= least_docs and i != max(holders[k], key=lambda j: (j is not None, j)) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(docs):
    rows = d.drop_shared_lines(docs).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)").collect()
    return sorted(map(tuple, rows), key=repr)


def test_all_documents_as_by_hand(spark, small):
    got = sorted(map(tuple, d.op13_line_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("rows", [
    [(i, f"own {i}\n  {LINE.upper()}\t\n{LINE}\n\nend\r") for i in range(5)],
    [(i, LINE) for i in range(4)] + [(3, f"{LINE}\nmore"), (3, LINE)],  # four documents only
    [(i, LINE) for i in range(4)] + [(None, LINE), (None, f"x\n{LINE}")],  # no id is one document
    [(7, LINE), (7, LINE), (7, "other"), *[(i, f"{LINE}\n{LINE}") for i in range(5)]],  # rows of the largest id keep all
    [(i, "x" * 39) for i in range(9)] + [(i, "é" * 40) for i in range(20, 29)],  # code points, not bytes
    [(i, "ÄÖÜ" * 20) for i in range(5)] + [(i, "äöü" * 20) for i in range(9, 12)],  # only A-Z are folded
    [(i, " " + "y" * 40) for i in range(5)] + [(9, "y" * 40)],  # only ASCII white space is stripped
    [(i, None if i % 2 else "") for i in range(12)],
    [(i, "\n" * i) for i in range(12)],
    [(i, (LINE + "\n") * 3000 + f"own {i}") for i in range(6)],
])
def test_cases(spark, rows):
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_hot_lines_stay(spark, monkeypatch):
    """With a low bound the shared lines are hot, and the rows of hot lines aren't shuffled; results are the same."""
    rows = [(i, f"{LINE}\n{LINE} {i % 7}\nown {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = result(docs)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert result(docs) == want == brute(rows)


def test_edge_rows(spark, edge, empty):
    assert result(edge) == brute([(r.doc_id, r.text) for r in edge.collect()])
    assert d.drop_shared_lines(empty).count() == 0


def test_plan_is_native(spark):
    plan = d.op13_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
