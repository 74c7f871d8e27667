"""Very long texts, in the pieces that operators cut them into."""

import random
from collections import Counter

import numpy as np
import pytest

from lumenbridge.llm import decontaminate, exact_dedup, lm_scoring, mixing, simhash

from .test_dedup import brute_fingerprint
from .test_scoring import brute_base, brute_hits


def long_text(words, seed=1):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(words))


@pytest.mark.parametrize("piece", [7, 100, 100_000])
def test_fingerprint_of_a_long_text(piece, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", piece)
    text = long_text(5000)
    assert simhash.fingerprint(text.encode()) == simhash._signed(brute_fingerprint(text))


def test_phrases_in_a_long_text():
    text, item = long_text(30_000), long_text(40, seed=9)
    whole = f"{text} {item} {text} {' '.join(item.split()[5:30])}"
    phrases = decontaminate.Phrases([("x", item.encode()), ("y", b"not here at all")])
    (n, spans, items), = decontaminate.scan([whole.encode()], phrases)
    (_, words, hit, n_items, _, _), = brute_hits([(1, whole)], [("x", item), ("y", "not here at all")])
    assert (n, sum(b - a for a, b in spans), len(items)) == (words, hit, n_items) and hit == 65


def test_long_texts_through_spark(spark, tmp_path, monkeypatch):
    rows = [(i, long_text(k, seed=i)) for i, k in enumerate([200_000, 3, 50, 200_000, 10])] + [(9, long_text(200_000, seed=0))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[9].keep_id == 0 and got[0].group_size == 2 and not got[9].kept
    assert {r.doc_id: r.component_id for r in simhash.near_dedup(docs).collect()}[9] == 0
    scores = lm_scoring.score_texts(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scores) == Counter((*b[:5], round(b[5], 4)) for b in brute_base(rows))
    assert {r.text for r in mixing.mix(docs).collect()} <= {t for _, t in rows}


def test_tables_of_a_mean_within_two_percent():
    """Means of the table counts against the exact law, for few customers and many."""
    from .test_gibbs import conditional

    for n, a in ((10, 2), (40, 2), (200, 2), (500, 2), (500, 20)):
        many = 40_000
        got = lm_scoring.gibbs_tables(np.full(many, n), np.full(many, float(a)), 0.75, np.arange(1, many + 1, dtype=np.uint64), 3)
        assert abs(got.mean() / (conditional(n, a, 0.75) @ np.arange(1, n + 1)) - 1) < 0.02
