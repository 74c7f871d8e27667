"""Sweeps of the language model's sampler against exact conditionals."""

import itertools

import numpy as np
import pytest

from lumenbridge.llm import lm_scoring


def conditional(n, a, d):
    """Probabilities of 1, 2, ... tables: a^t * S_d(n, t), normalised."""
    row = np.zeros(1)  # logarithms of S_d; one customer
    for m in range(1, n):
        stay = np.log(m - d * np.arange(1, m + 1)) + row
        row = np.logaddexp(np.append(stay, -np.inf), np.append(-np.inf, row))
    w = row + np.arange(1, n + 1) * np.log(a)
    w = np.exp(w - w.max())
    return w / w.sum()


def test_stirling_numbers_count_partitions():
    d, n = 0.75, 6
    want = np.zeros(n + 1)
    for seats in itertools.product(range(n), repeat=n):
        if all(s <= max(seats[:i], default=-1) + 1 for i, s in enumerate(seats)):
            sizes = np.bincount(seats)
            want[len(sizes)] += np.prod([np.prod(np.arange(1, s) - d) for s in sizes])
    assert np.allclose(np.exp(lm_scoring.stirling(d)[n, 1: n + 1]), want[1:])


@pytest.mark.parametrize("n, a, d", [(2, 1, 0.75), (10, 1, 0.75), (48, 3, 0.75), (48, 10, 0.75), (300, 5, 0.5)])
def test_tables_follow_the_conditional(n, a, d):
    want, many = conditional(n, a, d), 20_000
    got = lm_scoring.gibbs_tables(np.full(many, n), np.full(many, float(a)), d, np.arange(1, many + 1, dtype=np.uint64), 3)
    assert np.abs(np.bincount(got.astype(int), minlength=n + 1)[1:] / many - want).max() < 0.012


@pytest.mark.parametrize("n, a, d", [(600, 0.3, 0.5), (600, 0.3, 0.75), (600, 30, 0.75), (600, 100, 0.75), (600, 1000, 0.75)])
def test_tables_of_many_customers(n, a, d):
    want, many = conditional(n, a, d), 20_000
    got = lm_scoring.gibbs_tables(np.full(many, n), np.full(many, float(a)), d, np.arange(1, many + 1, dtype=np.uint64), 3)
    mean = want @ np.arange(1, n + 1)
    assert abs(got.mean() / mean - 1) < 0.025


@pytest.mark.parametrize("shape", [0.5, 1.0, 7.5])
def test_gamma_moments(shape):
    x = lm_scoring._gamma(np.full(40_000, shape), np.arange(1, 40_001, dtype=np.uint64), 5)
    assert abs(x.mean() - shape) < 0.03 * max(1, shape) and abs(x.var() / shape - 1) < 0.06
    assert lm_scoring._gamma(np.zeros(3), np.arange(3, dtype=np.uint64), 5).tolist() == [0, 0, 0]


def test_sweeps_of_a_restaurant_reach_its_joint_law():
    """Two dishes of one restaurant: sweeps by auxiliary gammas against the enumerated joint law of their tables."""
    d, strength, p, n = 0.75, 4.0, np.array([0.3, 0.7]), np.array([5, 9])
    s = lm_scoring.stirling(d)
    joint = np.array([[np.exp(s[5, i] + s[9, j]) * p[0] ** i * p[1] ** j * np.prod(strength + d * np.arange(i + j)) for j in range(1, 10)] for i in range(1, 6)])
    joint /= joint.sum()
    many = 20_000
    key = np.arange(1, many + 1, dtype=np.uint64)
    t = np.ones((2, many))
    for sweep in range(12):
        g = d * lm_scoring._gamma(strength / d + t.sum(axis=0), key, 500 + sweep)
        t = np.stack([lm_scoring.gibbs_tables(np.full(many, n[k]), g * p[k], d, key + np.uint64(k * many), sweep) for k in range(2)])
    got = np.zeros((5, 9))
    np.add.at(got, (t[0].astype(int) - 1, t[1].astype(int) - 1), 1 / many)
    assert np.abs(got - joint).max() < 0.012


def test_each_sweep_starts_from_the_last_and_draws_anew(docs, monkeypatch):
    seen, own = [], lm_scoring.exchange

    def spy(store, ask, answer, label, shards):
        path = own(store, ask, answer, label, shards)
        if label == "lm-tables":
            seen.append(tuple(lm_scoring.summed(store.sparkSession, path, 3)))
        return path

    monkeypatch.setattr(lm_scoring, "exchange", spy)
    assert lm_scoring.score_texts(docs).count()
    assert len(seen) == lm_scoring.ROUNDS + lm_scoring.SWEEPS and len({x[0] for x in seen}) > 2
