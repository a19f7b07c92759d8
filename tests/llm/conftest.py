import pytest
from pyspark.sql import Row


@pytest.fixture
def frame(spark):
    """Documents from texts: ids are places unless given; one extra column clashes in name
    with what operators put out."""

    def make(texts, ids=None, **extra):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", extra.get("sources", ["s"] * len(texts))[k], None if t is None else len(t), k, "x", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, spans string, fingerprint int")

    return make


@pytest.fixture
def collected():
    return lambda df: sorted(map(Row.asDict, df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, repr(r)))


#: Nulls, empty and blank texts, repeats, many bytes, no blanks, many blanks.
ODD = [None, "", " ", "\n\n\t", "a", "a b", "a b c", "ünï cödé 😀 文字", "A b C d", "a b c d", "same text here", "same text here", "x" * 50_000, "word " * 20_000, "1" * 30_000, "\0 nul", "  two  blanks  ", "▁ mark"]


@pytest.fixture
def odd():
    return list(ODD)
