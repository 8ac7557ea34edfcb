import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns named like outputs."""
    long = "the quick brown fox jumps over one lazy dog and runs far away " * 800
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve", "en"), (2, None, "en"), (3, "", None),
            (4, long, "en"), (4, long, "en"), (None, "alone without an id but with text", "en"), (None, None, None),
            (5, "123 456 --- !!!", "de"), (6, "Über den Wolken muß die Freiheit \U0001F600 wohl", "de"),
            (7, "one two three four five six seven eight nine ten eleven twelve", "en")]
    extra = [(*r[:2], r[2], "src", len(r[1] or ""), "x", 9, "y", 7, "z") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, id string, "
                                        "n_words int, fp string, component int, `a.b` string")


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
