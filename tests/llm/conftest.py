import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, bucket int, kept string, score double, component long, fp0 long"


def edge_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ñ漢".replace(" ", "")) for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(70))
    free = lambda n: " ".join(word() for _ in range(n))
    long_ = free(4000)
    near = free(120).split(" ")
    texts = [None, "", " \n\t ", "one", "a b", passage, passage, f"{free(30)} {passage}\n{free(30)}", f"{passage} {passage}", long_, long_ + " tail", free(50), "x " * 300, "ab" * 900]
    for _ in range(4):
        w = list(near)
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, ties, and columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "src", None, "r", i, 1, "k", 0.5, 7, 9) for i, t in enumerate(edge_texts())]
    rows += [rows[5], rows[11], (None, "no id at all", None, None, None, None, None, None, None, None, None, None), (3, "same id, another text", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
