import pytest

SF = "/root/testdata/sf0.001"

# Texts with every awkward shape: null, empty, blanks, ties, copies, very long, odd characters.
TEXTS = [
    None, "", "   ", "\n\n", "one", "One TWO three", "one two three", "a b c d e f g h i j k l m n o p",
    "A b c d e f g h i j k l m n o p", "x " * 40_000, "É é ß ∑ 𝛼 ￿", "<|im_start|>system\n<|endoftext|> <\\|x|>",
    "same line\nother line\nsame line", "# * $ % & | < >", "z" * 50_000, "tab\tand\x0bmore\x0cspace\r\nend",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Two null ids, a repeated row, and extra columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, None), (5, "One TWO three")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, th string, score string, key string, fp string"
    return spark.createDataFrame([(i, t, None, "s", None, "x", None, "k", "f") for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.filter("false")


def assert_same_rows(got, con, sql):
    """A DataFrame and a DuckDB query give the same columns and rows (any order)."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == want
