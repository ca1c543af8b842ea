import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, component_id string, size string"


def rows(texts, start=0):
    """Documents with columns whose names clash with those of the operators."""
    return [(start + i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4], len(t or ""), "x", 0.5, "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, long, special and foreign texts."""
    rng = random.Random(3)
    words = ["the", "house", "of", "Größe", "niño", "don't", "x1y2", "foo,", "1234567", "A.B", "été", "___", "...", "ﬁ", "İstanbul"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(30_000))
    made = [None, "", " \n\t ", "a", "Hello  World\n\n  x", "same text here", "same text here", long, "<|endoftext|> in <|startoftext|>text", "日本語 テキスト и русский", "é vs é ΣΑΣ", "tab\there\x0bvt\x0cff\rcr \x1c \x85  nb", "   lead", "trail   ", "a \n \n b", "it's we'll I'D"]
    return made + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) + ("\n" + rng.choice(words)) * rng.randrange(3) for _ in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    return spark.createDataFrame(rows(odd_texts), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizers():
    import public_tokenizers

    return public_tokenizers.path
