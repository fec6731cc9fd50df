import pytest

LOREM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()


def _text(seed: int, n: int) -> str:
    return " ".join(LOREM[(seed * 7 + i * (seed % 5 + 1)) % 16] + str((seed * 13 + i * i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case: nulls, empty and very long texts, ties, repeats, clashing columns."""
    base = _text(3, 60)
    rows = [(0, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "a"), (2, base + " x", "en", None), (3, None, "de", "b"), (4, "", None, "b"), (5, " \t\n ", "en", "b"), (6, "short one", "en", "c"), (7, "Short  ONE", "de", "c"), (8, "12 34 !!", "en", "c"), (9, _text(9, 30_000), "en", "a"), (10, "a b c d e", "en", "a"), (None, _text(11, 40), "de", "b"), (None, None, None, None), (12, base.replace("one", "ONE"), "en", "c"), (13, "shortone", "en", "c")]
    rows += [(100 + i, _text(100 + i, 20 + i % 50), ("en", "de")[i % 2], "ab"[i % 2]) for i in range(60)]
    return spark.createDataFrame([(*r, i, "clash", 1.5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, size long, component_id string, score double").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def make_text():
    return _text
