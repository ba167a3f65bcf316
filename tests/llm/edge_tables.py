import pytest

#: Names the operators use inside, as columns of the input.
CLASHING = ["row", "w", "key", "doc", "mark", "found", "id", "score", "tag", "size", "root", "copy", "numbers", "extra"]
LONG = "long " + " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (1, "same words here again and again to make a text of more than twenty words so that windows can be found in it twice", "a"),
        (1, "same words here again and again to make a text of more than twenty words so that windows can be found in it twice", "a"),
        (2, "same words here again and again to make a text of more than twenty words so that windows can be found in it twice", None),
        (3, None, "b"),
        (4, "", "b"),
        (5, " \n\t ", "b"),
        (6, "x", "b"),
        (None, "no id at all", "b"),
        (None, None, None),
        (7, LONG, "c"),
        (8, "y " * 500, "c"),
        (9, "mail a.b@c.de or 10.0.0.1 and ▁ 日本語 😀 \x00 end", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in CLASHING:
        df = df.selectExpr("*", f"concat('{name}', doc_id) as `{name}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
