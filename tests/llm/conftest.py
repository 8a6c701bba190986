import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6000


@pytest.fixture(scope="session")
def docs_schema():
    # besides the usual columns, names that the operators use inside or return
    extra = ["text_key", "tag", "node", "bucket", "shard", "__key", "__sha", "__flag", "hash", "kept", "class_id", "band", "component", "length", "spans", "key", "path", "host", "rank", "__doc_id"]
    return "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{e} string" for e in extra)


@pytest.fixture(scope="session")
def make(spark, docs_schema):
    """Rows of (doc_id, text) as a table of documents with clashing columns."""
    n = docs_schema.count(",") + 1

    def run(rows, parts=3):
        full = [(*r[:2], "en", "src1", None, *["x"] * (n - 5)) for r in rows]
        return spark.createDataFrame(full, docs_schema).repartition(parts)

    return run


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in either column, empty and blank texts, a very long one, repeated rows, one id with two texts, ties."""
    return [
        (1, "one two three four five six seven eight"),
        (2, "one two three four five six seven eight"),
        (2, "one two three four five six seven eight"),
        (3, "one two three four five six seven nine"),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (None, "one two three four five six seven eight"),
        (None, None),
        (7, LONG),
        (8, LONG + "end"),
        (9, "word"),
        (10, "word"),
        (11, "é ñ ß 😀 ab cd  x"),
        (12, "same id, first text of a few words"),
        (12, "same id, other text of a few words more"),
    ]
