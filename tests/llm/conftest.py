import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _sha string, text_sha256 int, label string, row string, at string"


def corpus(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source) with exact and near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(70), prose(9)
    texts = [prose(rng.randrange(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + "  ", "\t" + texts[2].upper(), texts[0].replace(" ", "\n", 3)]
    texts += [prose(20) + " " + passage + "\n" + prose(5), passage, passage + " " + prose(80), passage + " " + passage]
    base = prose(300)
    for k in range(6):
        words = base.split()
        words[10 * k + 5] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(8)}\n{line}{'x' * k}\n{prose(6)}" for k in range(4)]
    texts += [None, None, "", " \n\t ", "a", "b c", "same same " * 60, "same same " * 61, prose(4000), "\x1c odd   space\x0bhere", "é" * 40, "É Ñ"]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "hot", "cold", None])) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 1, "l", "r", "a") for i, t, la, s in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and whole rows that repeat."""
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in [(None, "a b c d e"), (None, None), (5, "a b c d e"), (5, "a b c d e"), (7, "q w"), (None, "a b c d e")]], SCHEMA)
