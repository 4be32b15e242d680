import pytest

from tidemark.llm.common import ready

WORDS = "the of and to in is that for it was on are with as by at this be from or".split()


def prose(rng, words):
    return " ".join((rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice(["er", "on", "th", "in", "an"]) for _ in range(rng.randint(1, 4)))) for _ in range(words)) + "."


@pytest.fixture
def documents(spark):
    """Rows with nulls, an empty text, repeated rows, a very long text and columns whose names clash with results."""
    import random

    rng = random.Random(5)
    ready(spark)
    texts = {1: prose(rng, 80), 2: None, 3: "", 4: prose(rng, 30_000), 5: prose(rng, 120), 7: " \t\n", 8: "x", 9: "line one here\nline one here\nline one here"}
    rows = [(k, t, "en", "src0", 1, "clash", 2.0) for k, t in texts.items()]
    rows += [(5, texts[5], "en", "src0", 1, "clash", 2.0), (10, texts[5], None, None, None, None, None), (None, texts[1], "de", None, 0, "x", 0.0), (6, texts[1] + " more words", "en", "src1", 0, "x", 0.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, score double")


@pytest.fixture
def nothing(spark):
    ready(spark)
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
