import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 10),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 10),
        (2, "alpha beta gamma delta epsilon zeta", "en", "b", 10),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, "   \n\t ", "de", "", 6),
        (None, "text without an id", "fr", "a", 18),
        (None, None, None, None, None),
        (7, long_text, "en", "a", len(long_text)),
        (8, "you are an idiot and a moron", "en", "b", 28),
        (9, "größe über straße 日本語 テスト 😀", "de", "b", 30),
        (10, "one", "en", "c", 3),
    ]
    extra = "shard int, slot int, size int, score double, okey string, tkey string, cls int, block int, bk int, fingerprint string, length int, copies int, y int, held int"
    helpers = "_id _key _doc_id _text_key _skey _cutoff _source _okey _slot _toxicity __toxicity skey bytes share epoch part first last copy kept class_id sketch fold bands sig one two grp".split()
    rows = [r + (1, 2, 3, 0.5, "k", "t", 4, 5, 6, "f", 7, 8, 1, 0) + tuple(f"{h} of {r[0]}" for h in helpers) for r in rows]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}, {', '.join(f'{h} string' for h in helpers)}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1), (8, 0, 1), (8, 0, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
