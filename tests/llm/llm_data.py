"""Texts, fixtures and small references shared by the tests."""

import pytest

from tablewright.llm.common import ship

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "This Line Is Shared By Many Documents, and long."
PASSAGE = " ".join(f"w{i}" for i in range(70))

#: (doc_id, text): nulls, blanks, other white space, exact copies, repeated rows, a long text.
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two\x0bthree \x85 four\xa0five"),
    (6, PASSAGE), (7, PASSAGE), (8, "start here " + PASSAGE + " end"), (9, PASSAGE.replace("w60", "x60")),
    (9, PASSAGE.replace("w60", "x60")), (10, "a b c a b c a b c\nq\nq\n\nq " * 30), (11, "x" * 5000),
    (12, "word " * 20_000), (13, "é日本 <|endoftext|> it's 12 \U0001F600  \n\n  end"), (14, "A # b % c | d < e\n" * 20),
    *[(20 + i, f"  {LINE.upper() if i % 2 else LINE}\t\nown line of {i}\n{LINE}") for i in range(7)],
    (None, LINE + "\n" + PASSAGE), (15, "tail\n"), (16, "one"),
]


def words(text):
    return (text or "").encode().split()


def key(line):
    return line.strip(WHITE).translate(LOWER)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """TEXTS with extra columns whose names the operators use themselves."""
    names = ["n_words", "keep", "row", "ids", "fp", "rate", "_w", "place", "host", "n_lines", "kept_text"]
    rows = [(i, t, *[f"{c}{n}" for c in names]) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(3)
