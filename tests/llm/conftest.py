import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, n string, h string, score string"


def corpus(seed=1):
    """Small texts with copies, near copies, shared passages and lines, and every odd case."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghéß") for _ in range(r.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    page = lambda k: "\n".join(say(r.randint(3, 12)) + "." for _ in range(k))
    texts = [page(r.randint(1, 9)) for _ in range(40)]
    passage = say(60)
    texts += [page(3) + "\n" + passage + "\n" + page(2) for _ in range(6)]
    base = say(200).split()
    for k in range(8):
        near = list(base)
        near[r.randrange(200)] = f"edit{k}"
        texts.append(" ".join(near))
    texts += [texts[3]] * 12 + [texts[5] + "\n" + page(1), "", " ", "one", "one two three four", "one two three four five", "!!! ??? 123", "und " * 900, "x" * 5000, "\n\n\n", "don't we'll  say\t'tis \U0001f600 日本語", page(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    rows += [(1000, None), (1001, None), (None, texts[7]), (2, texts[2]), (2, texts[2])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame(spark, rows):
    full = [(i, t, None if k % 7 == 0 else ("aa", "bb")[k % 2], f"s{k % 3}", None if t is None else len(t), "x", None, "y", "z", "w") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
