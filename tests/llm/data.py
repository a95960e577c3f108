"""Small made-up tables with awkward rows."""

import random

VOICE = "the of and river stone light winter garden letter window morning silver paper road hill bird cloud".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(VOICE) + str(rnd.randrange(40)) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) rows with the other columns of documents and one whose name clashes with an operator's."""
    full = [(i, t, "en", None, None if t is None else len(t), "x") for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, score string")


def awkward():
    """Null, empty, repeated, tied and very long rows, and one without an id."""
    return [(1, None), (2, ""), (3, "  \n "), (4, "short"), (4, "short"), (5, "short"), (None, "short"), (6, "é" * 3),
            (7, "word " * 60_000), (8, "x" * 300_000)]
