import pytest

from outflow.llm.catalog import ready

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def llm(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def documents(llm):
    """Documents from texts; ids count from zero."""

    def make(texts, lang="en", source="s"):
        rows = [(i, t, lang, source if isinstance(source, str) else source[i], len(t) if t is not None else None) for i, t in enumerate(texts)]
        return llm.createDataFrame(rows, DOCS)

    return make
