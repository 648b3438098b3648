import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, th string, key string, n long, size long, part int, n_removed string, w string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in each column, empty and long texts, repeated rows, and columns named as operators name their own."""
    long = " ".join(f"word{i % 977}" for i in range(10_000))
    lines = "first line here\nsecond line here\nthird line here\nfourth"
    texts = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (None, "a b c d e f g h"), (None, None), (3, ""), (4, long), (5, lines), (6, "x\n" + lines), (7, " \t\n"), (8, "under the MIT license"), (9, "password = hunter22"), (10, "퟿\U0001f600 ünï"), (4, long)]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), "d", "t", None, k, 7, 1, "r", "w") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
