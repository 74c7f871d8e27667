"""Language ID against naive Bayes written out plainly."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenbridge.llm import language_id as lid

SAY = {"en": "the house and the river with", "de": "das Haus und der Fluß mit über", "es": "la casa y el río con mañana"}


def bucket(gram):
    return int(lid.buckets(np.array([ord(c) for c in gram], dtype=np.uint32), len(gram))[0])


def grams(text):
    t = f" {text.lower()} "
    return [(k, bucket(t[i: i + k])) for k in lid.ORDERS for i in range(len(t) - k + 1)] if text else []


def brute(rows):
    learn = [(t, x) for i, t, x in rows if t is not None and x is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 5]
    langs = sorted({x for _, x in learn})
    counts, docs = {x: Counter() for x in langs}, Counter(x for _, x in learn)
    for t, x in learn:
        counts[x].update(b for _, b in grams(t))
    sizes = {x: sum(counts[x].values()) + lid.ALPHA * (1 << lid.BITS) for x in langs}
    out = []
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t) or not langs:
            out.append((i, "und", 0.0))
            continue
        logs = [math.log(docs[x] / len(learn)) + sum(math.log((counts[x][b] + lid.ALPHA) / sizes[x]) for _, b in grams(t)) for x in langs]
        top = max(logs)
        out.append((i, langs[logs.index(top)], 1 / sum(math.exp(v - top) for v in logs)))
    return out


def texts(n=60):
    rng = random.Random(4)
    mixed = lambda: " ".join(rng.choice(rng.choice([*SAY.values()]).split()) for _ in range(rng.choice([1, 2, 3])))
    rows = [(i, " ".join(rng.choice(SAY[k].split()) for _ in range(rng.choice([1, 4, 60]))), k) for i in range(n) for k in [rng.choice(["en", "en", "de", "es"])]]
    return rows + [(100 + i, mixed(), None) for i in range(10)] + [(200, None, "en"), (201, "", "de"), (202, "123 ²!?", "en"), (None, "der fluß", "de"), rows[3], rows[3]]


@pytest.mark.parametrize("piece, block", [(400_000, 256), (50, 256), (7, 256), (400_000, 2), (50, 1)])
def test_equals_naive_bayes_whatever_the_pieces_and_blocks(spark, monkeypatch, piece, block):
    monkeypatch.setattr(lid, "PIECE", piece)
    monkeypatch.setattr(lid, "BLOCK_LANGS", block)
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS best", "2 AS top", "'x' AS letters")
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in lid.identify(df).collect())
    assert got == sorted((str(i), x, round(s, 4)) for i, x, s in brute(rows))
    kept = lid.keep_identified(df)
    assert kept.columns == df.columns and {202, 201, 200}.isdisjoint(r.doc_id for r in kept.collect())


def test_many_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" * 6, f"l{i % 300:03}") for i in range(900)]
    got = lid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 900 and len({r.lang_pred for r in got}) > 250
