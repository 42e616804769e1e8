import pytest


@pytest.fixture
def docs(spark):
    def make(texts, ids=None):
        return spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts, strict=True)), "doc_id long, text string").repartition(3)

    return make


#: Texts at the edges that every operator has to bear.
EDGES = [None, "", " ", "\n\n", "one", "One one ONE", "a b c d", "a b c d e", "a b c d e", "é ü ß 日本 語", "x" * 5000, "word " * 3000, "\x00 \x1f y", "tab\tand\nline"]
