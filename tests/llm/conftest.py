import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: ids and texts: null id, null text, empty, blanks, repeated rows, ties, marks of the tokenizers, one very long.
ROWS = [
    (5, "The quick brown fox jumps over the lazy dog."),
    (3, "The quick brown fox jumps over the lazy dog."),
    (7, None), (8, ""), (9, " \n\t "), (None, "no id here, mail a.b@example.org"), (2, "twice"), (2, "twice"),
    (11, "a  b\n\n c ▁d <|endoftext|> </s>  "), (12, "日本語のテキスト 1.2.3.4 +1 (555) 123-4567, 4111 1111 1111 1111"), (1, LONG), (13, "x" * 5000), (14, "Ünïcödé ÀÉ z q 🙂"),
]
CLASH = ["score", "part", "copy", "print", "ids", "bucket", "y", "label_id", "sketch", "piece", "kind", "base", "candidates"]


@pytest.fixture(scope="session")
def edge(spark):
    """The odd rows with columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", "s", None, *CLASH) for i, t in ROWS], schema)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("1 = 0")


@pytest.fixture(scope="session")
def corpus(spark):
    """Labelled texts: junk repeats itself, toxic ones hold a word of a list."""
    r, rows, labels = random.Random(5), [], []
    for i in range(600):
        words = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('klmnrst')}{r.choice('aeiou')}" for _ in range(r.randint(30, 120))]
        good, toxic = i % 4 != 0, i % 5 == 1
        if not good:
            words = [w.upper() + "!!" for w in words[:5]] * 12
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["trashy", "trashes", "scummy", "vileness"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()
