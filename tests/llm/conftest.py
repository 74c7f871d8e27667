import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone Letter über naïve 42 x1 end, stop. go! mañana house blue green Tree light dark".split()


def make(seed=3, n=60):
    """Rows with copies, near copies, shared passages, repeats, odd white space, empty and null texts, ties and repeated rows."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(k))
    passage, rows = say(60), []
    for i in range(n):
        text = say(rng.choice([1, 2, 5, 30, 80, 200]))
        kind = i % 10
        if kind == 1 and rows:
            text = rng.choice([r[1] for r in rows if r[1]])
        elif kind == 2:
            text = say(10) + " " + passage + " " + say(7)
        elif kind == 3:
            text = "ab " * 150
        elif kind == 4:
            text = (rng.choice([r[1] for r in rows if r[1]])).replace(" ", " \t\n", 2)
        rows.append((i * 3 % n, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", None]), len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \n\t ", "en", "s1", 3), (903, "!!! ...", "en", "s1", 7), (904, passage, "en", "s0", 1), (905, "x" * 5000, "en", "s0", 5000), (None, say(50), "en", "s0", 1), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Three partitions, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("fp", "key", "norm", "salt", "sha", "payload", "chunk", "n_tokens", "score", "kept", "n_copies")}).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
