import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with every edge case: nulls, empty and blank texts, repeats, copies, a long text, a clashing extra column."""
    base = " ".join(f"w{i % 97} v{i * 7 % 31}" for i in range(300))
    near = base.replace("w5 ", "w5x ", 1)
    rows = [
        (0, base, 1), (1, near, 2), (2, base, 3), (3, None, 4), (4, "", 5), (5, " \t\n", 6), (6, "One two", 7), (7, "one  two", 8), (8, "only", 9), (9, "x " * 30000, 10),
        (10, 'key token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" end mail a.b@c.example.org, +1 (017) 555-7713 10.0.0.1', 11), (11, "héé " + base[:400], 12), (11, "héé " + base[:400], 12), (12, "a\x1cb <|endoftext|> 'Tis", 13), (None, "no id", 14),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, node long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
