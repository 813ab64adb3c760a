import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, a shared passage, nulls, empty and long texts."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(2, 9))) for _ in range(400)]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = line(60)
    out = [None, "", "  \n", "one two", "One  two", "x" * 5000, "ΣΑΣ İ 漢字 😀 ﬁ", "word " * 3000]
    for _ in range(40):
        out.append(" ".join(line(r.randint(1, 150))))
    for _ in range(30):
        out.append(" ".join(line(30) + passage + line(25)))
    for _ in range(4):
        start = line(200)
        for _ in range(14):
            copy = list(start)
            for _ in range(r.randint(0, 9)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    out += out[20:30]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
