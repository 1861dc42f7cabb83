import random

import pytest
from texts import prose, sentences

@pytest.fixture(scope="session")
def corpus():
    """doc_id, text: prose, exact and near copies, shared passages, repeated lines, junk, nulls and empties."""
    rng = random.Random(7)
    texts = ["\n".join(sentences(rng, rng.randint(1, 4)) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    passage = sentences(rng, 8)
    for i in range(0, 60, 7):
        texts[i] = f"{texts[i]}\n{passage}"
    for i in range(12):  # near copies: one or two words changed
        words = texts[i].split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += texts[:5] + [None, "", "   ", "One two", "one TWO", "!!! ### $$$", "\n\n\n", "x" * 5000, " ".join(prose(rng, 8000)), "É \x1c\u00a0 tab\tand\x0bvt\x0cff\r\nend"]
    texts += ["Shared footer line here\n" + t for t in texts[20:24]] + ["  SHARED footer line HERE\t\nother"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
