"""The pipeline against a reading of it by hand, stage by stage, on the smallest tables."""

import zlib

import numpy as np

import corpus_pipeline as cp
from quarrymill.llm import mixing, packing, pii, quality
from quarrymill.llm.common import table, written
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    outs = {}
    for name, stage in cp.STAGES:
        docs = outs[name] = written(stage(spark, docs, SF), name)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    start = table(spark, SF, "documents")

    good = {r.doc_id for r in quality.assess(start).where("kept").collect()}
    kept = {r.doc_id: r.text for r in outs["quality_rules"].collect()}
    assert set(kept) == good

    one = {r.doc_id: r.text for r in outs["near_duplicates"].collect()}
    assert set(one) == {d for d, _, c in brute(list(kept.items()), 5) if d == c}
    assert all(kept[d] == t for d, t in one.items())

    model = pii.train(outs["near_duplicates"])
    clean = {r.doc_id: r.text for r in outs["personal_data"].collect()}
    assert set(clean) == set(one)
    for d, text in one.items():
        base, added = pii.find_spans(text, model)
        assert (clean[d] == text) == (not base and not added)
        assert not any(text[s:e] in clean[d] for s, k, e in base if k == "email")

    took = {r.doc_id: r.taken for r in mixing.mix(outs["personal_data"]).collect()}
    mixed = outs["mix_sources"].collect()
    have = {}
    for r in mixed:
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.encode().split())
        assert set(r.text.encode().split()) <= set(clean[r.doc_id].encode().split())
    assert have == {d: n for d, n in took.items() if n}

    want = sorted(tuple(packing.token_ids(r.text).tolist()) for r in mixed)
    pieces = [r.asDict() for r in outs["pack_sequences"].collect()]
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    crcs = {zlib.crc32(np.array(x, "<u4").tobytes()) for x in want}
    assert all(p["ids_crc32"] in crcs for p in pieces if p["length"] == p["doc_tokens"])
    # run() is the same stages; its rows are those of the last one
    key = lambda p: (p["doc_id"], p["start"], p["length"], p["ids_crc32"])
    assert sorted(map(key, pieces)) == sorted(key(r.asDict()) for r in cp.run(spark, SF).collect())


def test_empty_documents(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_edge_rows(spark, edge):
    """Through the stages behind the rules, which let few of these through: every text's words arrive as often as the mix takes them."""
    docs = edge
    for name, stage in cp.STAGES[1:-1]:
        before, docs = docs, written(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    mixed = docs.collect()
    took = {}
    for r in mixing.mix(before).collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
    have = {}
    for r in mixed:
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.encode().split())
    assert have == {k: v for k, v in took.items() if v} and None in have
    pieces = written(packing.pack(docs), "packed").collect()
    assert sum(p.length for p in pieces) == sum(len(packing.token_ids(r.text)) for r in mixed)


def test_rules_on_edge_rows(spark, edge):
    """The first stage keeps the long prose, and of it every row."""
    kept = cp.quality_rules(spark, edge, SF).collect()
    judged = [r for r in quality.assess(edge).collect() if r.kept]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == sorted((r.doc_id is None, r.doc_id) for r in judged)
    assert not {0, 1, 2, 3} & {r.doc_id for r in kept}
