"""The whole language model against a sampler that seats customers one by one, and its sums."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from lumenbridge.llm import exchange
from lumenbridge.llm import lm_scoring as lm

TEXTS = ["a b a b c", "a b c d", "b a b a b a", "c a b", "d d d d d d a", "a b e", "", "f a b"]
#: The first eight ids outside the held-out fold, and one inside.
TRAIN = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][: len(TEXTS)]
HELD = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)
END, START = "</s>", "<s>"


class Restaurant:
    """Tables of each dish, as lists of their customers."""

    def __init__(self, discount, strength, parent):
        self.d, self.s, self.parent, self.tables = discount, strength, parent, defaultdict(list)

    def prob(self, dish):
        own, tables = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
        p = self.parent.prob(dish)
        return p if not own else (sum(self.tables[dish]) - self.d * len(self.tables[dish]) + (self.s + self.d * tables) * p) / (self.s + own)

    def add(self, dish, rng):
        new = (self.s + self.d * sum(map(len, self.tables.values()))) * self.parent.prob(dish)
        odds = [k - self.d for k in self.tables[dish]] + [new]
        at = rng.choices(range(len(odds)), odds)[0]
        if at == len(self.tables[dish]):
            self.tables[dish].append(1)
            self.parent.add(dish, rng)
        else:
            self.tables[dish][at] += 1

    def remove(self, dish, rng):
        at = rng.choices(range(len(self.tables[dish])), self.tables[dish])[0]
        self.tables[dish][at] -= 1
        if not self.tables[dish][at]:
            del self.tables[dish][at]
            self.parent.remove(dish, rng)


class Base:
    def __init__(self, known):
        self.known = known

    def prob(self, dish):
        return (1 - lm.UNKNOWN) / len(self.known) if dish in self.known else lm.UNKNOWN

    def add(self, dish, rng): ...
    def remove(self, dish, rng): ...


def brute_probabilities(pairs, sweeps=1500):
    rng = random.Random(5)
    seen = [(u, w) for t in TEXTS for u, w in zip([START, *t.split()], [*t.split(), END])]
    root = Restaurant(lm.ROOT_DISCOUNT, lm.ROOT_STRENGTH, Base({w for _, w in seen}))
    rooms = defaultdict(lambda: Restaurant(lm.DISCOUNT, lm.STRENGTH, root))
    for u, w in seen:
        rooms[u].add(w, rng)
    total = Counter()
    for sweep in range(sweeps + 50):
        for u, w in seen:
            rooms[u].remove(w, rng)
            rooms[u].add(w, rng)
        if sweep >= 50:
            for u, w in pairs:
                total[u, w] += rooms[u].prob(w) / sweeps
    return total


def sweeps_in_process(monkeypatch, rounds=20, sweeps=400):
    """The model's own passes, one chunk and one shard, without Spark; gives words, counts and states."""
    store = {}
    monkeypatch.setattr(lm, "answers_of", lambda path, chunk: store[path])
    # the held-out text makes every pair of words a bigram of the chunk
    words = sorted({w for t in TEXTS for w in t.split()}) + ["unseen"]
    every = " ".join(f"{u} {w}" for u in words for w in words)
    _, packed = lm._pack([*TRAIN, HELD, HELD], [t.encode() for t in TEXTS] + [every.encode(), " ".join(words).encode()])
    c = lm.Chunk(packed)
    (_, (known,)), (_, counts) = lm._answer_counts([(0, q) for _, q in lm._ask_counts(1)(0, packed)])
    store["counts"] = [(0, counts)]
    n, v = float(sum(len(t.split()) + 1 for t in TEXTS)), known
    kept = exchange.load(next(lm._seats("counts")(0, packed)).column("payload")[0].as_py())
    states = [lm.State(0)]
    for sweep in range(1, rounds + sweeps + 1):
        (_, said), (_, tables) = lm._answer_tables(v, states[-1])([(0, q) for _, q in lm._ask_tables(1, n, v, states[-1])(0, kept)])
        store[f"t{sweep}"] = [(0, tables)]
        states.append(lm.State(sweep, f"t{sweep}", *said))
    count, pairs, _ = lm.counted("counts", 0, c)
    return words, c, lm.Words(0, c.words, count, n, v), pairs, states[rounds:]


def test_scores_equal_customers_seated_one_by_one(monkeypatch):
    words, c, m, pairs, states = sweeps_in_process(monkeypatch)
    got = lm.predictive(m, c.u, c.w, pairs, c.key, states)
    name = {int(h): w for w in [*words] for h in [lm.xxhash.xxh64_intdigest(w.encode())]} | {int(lm.END): END}
    label = [name[int(h)] for h in m.words] + [START]
    mine = {(label[u], label[w]): p for u, w, p in zip(c.u, c.w, got)}
    want = brute_probabilities(list(mine))
    assert len(mine) > 50
    off = [math.log10(mine[k] / want[k]) for k in mine]
    assert max(map(abs, off)) < 0.05 and abs(np.mean(off)) < 0.01


def test_probabilities_of_known_words_and_the_unknown_sum_to_one(monkeypatch):
    words, c, m, pairs, states = sweeps_in_process(monkeypatch, 2, 3)
    counts = {(u, w): (n, k) for u, w, n, k in zip(c.u.tolist(), c.w.tolist(), pairs, c.key)}
    size = len(m.words)
    for u in set(range(size + 1)) - {int(np.searchsorted(m.words, lm.END))}:  # nothing follows the end
        w = np.arange(size)  # the known words, the end, and one unknown word
        n = np.array([counts.get((u, int(x)), (0.0, 0))[0] for x in w])
        p = lm.predictive(m, np.full(size, u), w, n, lm.keys_of(m.words, np.full(size, u), w), states)
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
