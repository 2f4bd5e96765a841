import pytest

ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (3, None),
    (4, ""),
    (5, "one two"),
    (6, "one two"),
    (7, "é " * 3000 + "end"),
    (7, "é " * 3000 + "end"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (9, "x" * 70000),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(d, t, "T", 5, "n") for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, tie string, node int, bucket string").repartition(3)
