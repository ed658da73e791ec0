import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, sig long, n int, key string, hit string, x string, "
          "score string, held_out string, text_bytes string, component string, start string, spans string")


@pytest.fixture(scope="session")
def texts():
    """Prose of made-up words with copies, edited copies, shared passages and odd texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = [prose(150) for _ in range(6)]
    shared = prose(70)
    out = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            out.append(prose(rng.randint(1, 200)))
        elif kind == 1:
            out.append(rng.choice(base))
        elif kind in (2, 3):
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        elif kind == 4:
            out.append(prose(40) + "\n" + shared + "\n" + prose(30))
        else:
            out.append(prose(60).capitalize() + ".\nÉté à la " + prose(10) + "!\n\n")
    out += ["", " \t\n", None, "one", "one two three", "One  two\tthree", "é" * 500, "x" * 3000, "ab " * 700, prose(9000), "\x1c a\x1db",
            "日本語 テキスト 日本語 テキスト 日本語", "don't 'S <|endoftext|> x"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with extra columns whose names clash with the operators' own;
    repeated rows, a repeated id with another text and null ids among them."""
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (3, "another text with the id three", "en", "s", 1), (None, texts[1], None, "s", 1), (None, None, None, None, None)]
    clash = (1, 2, "k", "h", "x", "sc", "ho", "tb", "c", "st", "sp")
    return spark.createDataFrame([(*r, *clash) for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, (i % 4 > 0) * 1, 0) for i in range(0, len(texts), 2)] + [(5, None, 0), (2, 1, 0), (9999, 1, 0), (None, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
