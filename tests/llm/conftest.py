import pytest

EXTRA = "row string, id long, key string, gone int, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows, and columns that clash with inner names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    long = "\n".join(" ".join(words[(i * 7 + j) % 20] for j in range(12)) for i in range(400))
    rows = [
        (1, long),
        (2, long),  # exact copy
        (3, long + "\nand one more line at the end of it all"),  # near copy
        (4, ""),
        (5, None),
        (6, "short"),
        (6, "short"),  # repeated row
        (7, "SHORT"),
        (8, "!!! 123 ???"),
        (9, "write to jane.doe@mail.example.com or +1 (555) 555-0199 now, 10.0.0.1, 4111 1111 1111 1111"),
        (None, "a row without an id, alpha beta gamma delta"),
        (None, None),
        (10, "x" * 60_000),
        (11, " \t\n  \n\n"),
        (12, "password=abc12345def678 and the rest of this line\n" * 3),
    ]
    full = [(i, t, "r", 1, "k", 2, "s") for i, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id < 0")
