import pytest

#: (doc_id, text): repeats, ties, empties, nulls, long words, other scripts, white space of many kinds.
SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank while seven grey birds watch from a tall tree"
PASSAGE = " ".join(f"word{i}" for i in range(70))
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, SENTENCE), (6, SENTENCE), (7, SENTENCE.replace(" ", "  ")), (7, SENTENCE), (7, SENTENCE),
    (8, " ".join(f"alpha{i} beta{i}" for i in range(60))), (9, PASSAGE), (10, "start here " + PASSAGE + " and end there"), (11, "other " + PASSAGE[:600] + " tail"),
    (12, "x " * 3000), (13, "é" * 900), (14, "line one is here\n" * 40), (15, "Ünïcödé　wide space\x85next 中文字符 don't stop '' 12ab34"),
    (16, "<|endoftext|> in <|startoftext|> text ((('s \x1c\x1d"), (None, PASSAGE + " nulls"), (None, None), (17, " ".join(f"w{i % 97}x{i}" for i in range(9000))), (-4, "negative id"), (1 << 60, "large id " + SENTENCE),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with further columns, some of which are named like the operators' own."""
    rows = [(d, t, "x", len(t or ""), 1, True, "k", 0) for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, length long, kept boolean, key string, fp0 int")


@pytest.fixture(scope="session")
def plain(docs):
    return docs.select("doc_id", "text")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
