import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given texts; ids from 0, one source in three is null."""

    def make(texts, langs=None, ids=None):
        rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return make


#: nulls, empties, blanks, repeats, long texts, letters of many scripts
ODD = [None, "", " ", "\n\n", "a", "a", "A", "Ünïcödé çà ΑΣΣ İı ß ǅ", "日本語 テキスト 한국어 العربية हिन्दी", "x" * 5000, "word " * 3000, "<|endoftext|> and <|startoftext|>it's  we'll  x\x1c\x85y", "12345 ½ ²³ !!! ???", "tab\tsep\r\nline", None, "é decomposed", "👩‍👩‍👧 emoji 🎉"]
