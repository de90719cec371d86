import pytest
from llm_cases import word_texts

#: Columns that operators use inside: a table may have them too.
CLASHES = ["ids", "decoded", "k", "z", "fp", "h", "score", "n_words", "hit_words", "hit_items", "key", "keep", "rest", "TEXT", "Doc_ID"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank, very long, repeated and non-ASCII texts, and clashing columns."""
    base = word_texts(1, 12)
    texts = [*base, base[3], base[3], None, "", "   \n\t ", "é ü ñ 日本語 😀", "<|endoftext|>x", "a" * 300, (base[5] + "\n") * 400, "one two three"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, base[4], "en", "s", 1), (3, base[3], "en", "s", 1), (3, base[6], None, None, None)]
    frame = spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], SCHEMA + "".join(f", c{i} string" for i in range(len(CLASHES))))
    return frame.toDF("doc_id", "text", "lang", "source", "n_chars", *CLASHES).repartition(3), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
