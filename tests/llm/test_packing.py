import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarrymill.llm import packing


def pieces(df):
    return [r.asDict() for r in df.collect()]


def check(rows, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t in docs)
    seqs, by_doc = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    return want, by_doc, seqs


def test_documents(spark, small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    rows = pieces(packing.pack(small))
    _, by_doc, seqs = check(rows, docs)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc_id, len(ids)], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    fill = sum(r["length"] for r in rows)
    assert 1024 * len(seqs) < 1.05 * fill + 4096


def test_edge_cases(spark, edge, empty):
    rows = pieces(packing.pack(edge))
    check(rows, [(r.doc_id, r.text) for r in edge.collect()])
    assert {(r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] in (0, 1)} == {(0, 1, 1)}
    assert packing.pack(empty).count() == 0


def test_reruns_agree(spark, small):
    key = lambda r: tuple(r.values())
    assert sorted(pieces(packing.pack(small)), key=key) == sorted(pieces(packing.pack(small)), key=key)


SPECIAL = "<|endoftext|>"


def test_ids_are_those_of_the_json_vocabulary():
    """Texts with the added token anywhere, cut, nested or repeated, and awkward ordinary ones; the tokenizer as it is loaded."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a {SPECIAL} b", SPECIAL, SPECIAL * 3, f"{SPECIAL}x", f"x{SPECIAL}", f"  {SPECIAL}  ", f"\n{SPECIAL}\n\n", "<|endoftext|", "<|endof<|endoftext|>text|>", "<|ENDOFTEXT|>", f"Ä{SPECIAL}é 你好{SPECIAL}🎉", "", " ", "\t \r\n", "don't we'll 1234567 x_y", "a" * 3000, "\u200b\u00a0e\u0301"]
    rng = random.Random(4)
    bits = [SPECIAL, "<|", "|>", "endoftext", " ", "\n", "word", "é", "1", "'s", "你", "\u00a0"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    for t in texts:
        assert packing.token_ids(t).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t


def test_pieces_of_texts_with_the_added_token(spark):
    docs = [(1, f"a {SPECIAL} b"), (2, SPECIAL * 1500), (3, f"x {SPECIAL}" + " word" * 5000)]
    rows = pieces(packing.pack(spark.createDataFrame(docs, "doc_id long, text string")))
    _, by_doc, _ = check(rows, docs)
    assert {n for _, n in by_doc} == {5, 1501, 5004}


def test_open_windows_stay_bounded():
    w = packing.OpenWindows(100, 4, 5)
    for n in [60, 70, 80, 90, 50, 50, 30, 99, 1, 45] * 50:
        total = 0
        for _, offset, length in w.place(n):
            assert 0 <= offset and offset + length <= 100
            total += length
        assert total == n and len(w.free) <= 4


def test_leftovers_of_small_partitions_share_windows(spark):
    """Two short documents a partition: all but the last window of each sixteen partitions are nearly full."""
    docs = [(i, f"word{i} and some more of it " * (3 + i % 11)) for i in range(128)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(docs, 64), "doc_id long, text string")
    rows = pieces(packing.pack(frame))
    _, _, seqs = check(rows, docs)
    fill = sum(r["length"] for r in rows)
    assert 1024 * len(seqs) < 1.05 * fill + 4 * 1024
