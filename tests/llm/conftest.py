import pytest

ODD_TEXTS = [
    None, "", " ", "\n\t", "a", "A a\x0b a", "one two three four", "One  two three\nfour", "é È ñ", "x" * 5000, "wörd " * 3000,
    "a <|endoftext|> b", "▁ mark", "a\x00b\x1cc", "\U0001d4b3 日本語", "  lead and trail  ", "tab\tsep", "it's don't  we'll", "1.2.3.4 5", "é combining",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in any column, ties, repeats, long and odd texts, and columns whose names clash with internal ones."""
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "null id", "s1", 0), (None, "null id", "s1", 0), (3, ODD_TEXTS[3], "s0", 3), (4, "a", None, 4), (4, "other text of the same id", None, 4)]
    schema = "doc_id long, text string, source string, n long"
    df = spark.createDataFrame(rows, schema)
    for name in ("lang", "_text", "_len", "x", "p", "node", "label", "kind", "start", "end", "size", "copies", "_take", "_gone", "digest", "revisit"):
        df = df.selectExpr("*", f"doc_id AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
