import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, label string, node long, tie string, held_out string, slot int"


def edge_rows():
    words = " ".join(f"word{i % 977} and then other{i}" for i in range(9_000))
    prose = "the quick brown fox jumps over the lazy dog near the river bank today and nobody minds at all " * 4
    texts = [None, "", "  \n\t ", "one", "two words", prose, prose, words, "a b c d e f g h", "Äöü ß éè 你好 🎉", "x" * 50_000]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, prose, None, "s1", len(prose)), (5, prose, None, "s1", len(prose)), (None, "no id here", "en", "s1", 10), (None, None, None, None, None)]
    return [(*r, 7, True, "x", 1, "t", "h", 3) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns whose names clash."""
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
