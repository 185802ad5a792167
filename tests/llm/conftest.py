import pytest

CLASHING = "kind int, block int, row long, key long, n long, h1 long, spans string, one int, train boolean, lang string, source string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from ``(id, text)`` pairs, with further columns whose names operators use inside."""

    def make(rows, parts=2):
        full = [(i, t, 1, 2, 3, 4, 5, 6, "x", 7, True, "en" if k % 2 else "fr", f"s{k % 3}") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, f"doc_id long, text string, {CLASHING}").repartition(parts)

    return make


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
HOSTILE = [(None, "no id here, but some words of text"), (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "same text twice, word for word, in two rows"), (5, "same text twice, word for word, in two rows"), (6, LONG), (7, "\x00\x1c odd   spaceś and 日本語 'tis 🙂"), (8, "same text twice, word for word, in two rows")]


@pytest.fixture(scope="session")
def hostile(frame):
    return frame(HOSTILE)
