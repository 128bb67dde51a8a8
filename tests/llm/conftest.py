import pytest

WORDS = "the of and that with rain over hills slow river runs cold under old stone bridge while birds sing far away in morning light".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) * (r.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows; further columns that are named like results."""
    a = prose(60, 1)
    rows = [
        (1, a, "en", "s1"), (1, a, "en", "s1"), (2, a, "en", "s2"), (3, "", "en", "s1"), (4, "", None, None), (5, None, "en", "s1"), (None, a + " tail", "en", "s2"),
        (None, None, None, None), (6, prose(20_000, 2), "en", "s1"), (7, "x" * 50_000, "de", None), (8, "two words", "en", "s2"), (9, "!!! ???", "en", "s1"), (10, " \n\t ", "en", "s1"),
    ]
    return [(*r, i, "kept", 0.5) for i, r in enumerate(rows)]


EXTRA = "size long, shard string, score double"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
