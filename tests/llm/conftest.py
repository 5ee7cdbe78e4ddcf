import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text, ...) as a DataFrame with the given schema."""
    return lambda rows, ddl="doc_id long, text string, lang string, source string, n_chars long": spark.createDataFrame(rows, ddl)


def docs_of(texts, start=0, lang=None):
    return [(start + k, t, lang, "s", len(t) if t is not None else None) for k, t in enumerate(texts)]


#: Cases every operator has to take: NULL, empty, blanks only, repeated, very long, signs, rare letters.
ODD_TEXTS = [
    None, "", " ", "\n\n \t", "word", "word", "word " * 30_000, "x" * 70_000, "A\x00b\x01c", "日本語のテキスト", "İstanbul ΑΣ ß ﬁ", "😀 😀",
    "<|endoftext|> <s> ▁▁ a  b   c\n d", "a.b,c. d , e", "\x1c\x85\xa0　x", "one two three four five six seven eight nine ten " * 40,
]
