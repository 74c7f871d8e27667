"""LM scoring: a hierarchical Pitman-Yor bigram model.

Every word is the context of a restaurant; all context restaurants share one
parent, the unigram restaurant, whose base gives half of its mass to an unknown
word and the rest evenly to the known ones. Customers of a context are the
training tokens after it; tables of the contexts are the parent's customers.

Seating is drawn by blocked Gibbs sampling. Customers are first seated one
after another by the Chinese restaurant rule (``seat``); every later sweep
redraws the tables of all dishes given the state that the sweep before left.
With auxiliary gamma variables the conditional falls apart into dishes: given
g ~ Gamma(strength / discount + tables of the restaurant) and a draw p of the
parent's distribution, a dish with n customers has t tables with odds
a^t * S_d(n, t), where a = discount * g * p(dish) and S_d are generalised
Stirling numbers (``gibbs_tables``). So all dishes of a sweep are drawn at once
and the order of chunks does not matter. Two things are not exact: above
``STIRLING`` customers t is drawn from a limit law of the same conditional, and
the part of p that lies outside the parent's tables has its mean in place of a
draw. The seating and the ``ROUNDS`` - 1 sweeps after it are burn-in;
predictive probabilities are averaged over the next ``SWEEPS`` sweeps.

Counts are exact and over all training documents. Documents stay packed in
their chunks; shards of word and bigram hashes sum what chunks send and answer
each with its own keys' totals, so nothing is collected or broadcast but a few
totals. Random numbers are hashes of (bigram, sweep, customer), so any chunk
that holds a bigram draws the same seating for it, in any attempt.

Words and bigrams are told apart by 64-bit hashes; were two to collide, they
would share their counts. A bigram is drawn by the first chunk that holds it:
what the sweeps need of these is kept in a table of its own, so only the first
and the last pass read whole chunks.

Defined cases: a null or empty text is one end token; repeated rows count, and
score, once each; null ids hash as an empty text; a very long text is a chunk
of its own; without training documents every token has probability one; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import TO_LOWER, discard, discard_path, materialise, table
from .exchange import STORE, answers_of, chunk_store, dump, exchange, mix64, over_chunks, shards_for, summed, to_shards

FOLDS, OUT = 7, 2
#: Discount and strength of contexts and of the parent.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 4.0, 0.5, 1.0
UNKNOWN = 0.5
ROUNDS, SWEEPS, EXACT = 2, 3, 48
#: Dishes with up to so many customers have their tables drawn with Stirling numbers.
STIRLING = 512
#: Dishes whose odds are taken at once.
ROWS = 4096
PER_SHARD = 2_000_000
#: Random streams of a sweep's gamma variates of contexts and of words, and of the parent's tables.
CONTEXT_STREAM, WORD_STREAM, ROOT_STREAM = 10_000, 20_000, 30_000
ROOT = np.array([0x2545F4914F6CDD1D], dtype=np.uint64)
#: Hashes of the end token, and of the context of a document's first token.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bits of a bigram's key that are sent as they are; the ones above are sorted and sent as differences.
LOW = 24
LOW_BITS, LOW_MASK = np.uint64(LOW), np.uint64((1 << LOW) - 1)


def held_out_id(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == OUT


def pack_ints(x: np.ndarray) -> tuple:
    """Non-negative integers as byte planes; planes of zeros are left out."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x), [p.tobytes() if p.any() else None for p in planes]


def unpack_ints(packed: tuple) -> np.ndarray:
    n, planes = packed
    out = np.zeros((n, 8), dtype=np.uint8)
    for k, p in enumerate(planes):
        if p is not None:
            out[:, k] = np.frombuffer(p, dtype=np.uint8)
    return out.reshape(-1).view("<u8").copy() if n else np.zeros(0, dtype=np.uint64)


def _pack(ids, texts):
    lists = pc.ascii_split_whitespace(pa.array([t.translate(TO_LOWER) for t in texts], pa.binary()).view(pa.string()))
    offsets, found = lists.offsets.to_numpy(), lists.flatten()
    some = pc.greater(pc.binary_length(found), 0)  # white space at an end gives an empty one
    upto = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    words = found.filter(some).dictionary_encode()
    counts = np.diff(upto[offsets - offsets[0]])
    lengths = counts + 1
    distinct = _slices(words.dictionary)
    tokens = np.full(int(lengths.sum()), len(distinct), dtype=np.int64)
    body = np.ones(len(tokens), dtype=bool)
    body[np.cumsum(lengths) - 1] = False
    tokens[body] = words.indices.to_numpy()
    hashes = np.append(np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct)), END)
    by = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # frequent words get small numbers
    new = np.empty(len(by), dtype=np.int64)
    new[by] = np.arange(len(by))
    return len(tokens), ([*ids], lengths, pack_ints(new[tokens]), hashes[by])


def _slices(strings: pa.Array) -> list[bytes]:
    """The strings' bytes, cut out of their buffer."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[strings.offset: strings.offset + len(strings) + 1].tolist() if len(strings) else [0]
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(ends, ends[1:])]


def sorted_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative codes in order, and their places; both in one integer where they fit, as that sorts faster."""
    bits = len(codes).bit_length()
    if int(codes.max(initial=0)).bit_length() + bits <= 63:
        both = np.sort(codes << bits | np.arange(len(codes)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(codes, kind="stable")
    return codes[order], order


class Chunk:
    """A chunk's words in the order of their hashes, and its bigrams in the order of their words; ``by`` puts bigrams in the order of their keys."""

    def __init__(self, packed):
        self.ids, self.lengths, tokens, hashes = packed
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.words = hashes[order]
        self.token = place[unpack_ints(tokens).astype(np.int64)]
        self.n = len(self.words)
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.out = np.array([held_out_id(i) for i in self.ids], dtype=bool)
        self.train = ~self.out[self.doc]
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = self.n  # the start
        codes, places = sorted_places(before * (self.n + 1) + self.token)
        new = np.concatenate(([True], codes[1:] != codes[:-1]))
        self.bigram = np.empty_like(places)
        self.bigram[places] = np.cumsum(new) - 1
        self.u, self.w = (x.astype(np.int32 if self.n < 1 << 31 else np.int64) for x in np.divmod(codes[new], self.n + 1))
        self.key = keys_of(self.words, self.u, self.w)

    @functools.cached_property
    def by(self) -> np.ndarray:
        if len(self.key) >> LOW:
            return np.argsort(self.key, kind="stable")
        return (np.sort(self.key >> LOW_BITS << LOW_BITS | np.arange(len(self.key), dtype=np.uint64)) & LOW_MASK).astype(np.int64)

    def slices(self, keys: np.ndarray, shards: int) -> np.ndarray:
        return np.searchsorted(to_shards(keys, shards), np.arange(shards + 1))


def keys_of(words: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of bigrams from their words' places."""
    return mix64(np.append(words, START)[u] * np.uint64(0x9E3779B97F4A7C15) + words[w])


def _ask_counts(shards: int):
    def ask(_, packed):
        c = Chunk(packed)
        words = np.bincount(c.token[c.train], minlength=c.n)
        pairs = np.bincount(c.bigram[c.train], minlength=len(c.key))[c.by]
        key = c.key[c.by]
        a, b = c.slices(c.words, shards), c.slices(key, shards)
        for k in range(shards):
            i, j = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
            yield k, (c.words[i], pack_ints(words[i]), pack_ints(np.diff(key[j] >> LOW_BITS, prepend=np.uint64(0))), pack_ints(key[j] & LOW_MASK), pack_ints(pairs[j]))

    return ask


def _totals(keys: list[np.ndarray], values: list[np.ndarray]):
    """Distinct keys, their totals, where each row's key is, and the first row of each. Runs of sorted keys are merged."""
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.append(True, every[1:] != every[:-1])[: len(every)]
    which = np.empty(len(every), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return every[new], np.bincount(which, weights=np.concatenate(values), minlength=int(new.sum())), which, order[new]


def _answer_counts(asked):
    _, total, which, _ = _totals([q[0] for _, q in asked], [unpack_ints(q[1]).astype(float) for _, q in asked])
    known = int((total > 0).sum())
    words = np.split(total[which], np.cumsum([len(q[0]) for _, q in asked])[:-1])
    keys = [np.cumsum(unpack_ints(q[2]), dtype=np.uint64) << LOW_BITS | unpack_ints(q[3]) for _, q in asked]
    _, total, which, first = _totals(keys, [unpack_ints(q[4]).astype(float) for _, q in asked])
    owner = np.zeros(len(which), dtype=bool)
    owner[first] = True
    cut = np.cumsum([len(k) for k in keys])[:-1]
    pairs, owners = np.split(total[which], cut), np.split(owner, cut)
    return [(-1, (float(known),)), *((chunk, (pack_ints(a), pack_ints(b), np.packbits(o))) for (chunk, _), a, b, o in zip(asked, words, pairs, owners))]


def _uniform(key: np.ndarray, stream: int, number: int) -> np.ndarray:
    x = mix64(key.astype(np.uint64) + np.uint64(((stream << 32 | number) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _poisson(mean: np.ndarray, key: np.ndarray, stream: int, number: int) -> np.ndarray:
    u = _uniform(key, stream + (1 << 20), number)
    out = np.zeros(len(mean))
    low = mean < 12
    term = np.exp(-mean[low])
    cdf, left = term.copy(), u[low]
    got = np.zeros(int(low.sum()))
    for k in range(1, 60):
        got += left > cdf
        term = term * mean[low] / k
        cdf += term
    out[low] = got
    z = np.sqrt(-2 * np.log(u[~low])) * np.cos(2 * np.pi * _uniform(key[~low], stream + (2 << 20), number))
    out[~low] = np.maximum(0, np.round(mean[~low] + np.sqrt(mean[~low]) * z))
    return out


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, first: int) -> np.ndarray:
    """Tables that the customers (1 at least) of each dish open when seated one after another: the sum of ``SWEEPS`` draws.

    ``weight`` is the odds of a new table, ``first`` numbers the draws' random streams. This starts the
    sampler; it is no draw from the conditional given all other tables, which ``gibbs_tables`` makes.
    """
    tables = np.full(len(customers), float(SWEEPS))  # the only customer has the only table
    more = np.flatnonzero(customers > 1)
    by = more[np.argsort(-customers[more], kind="stable")]
    c, a, k = customers[by].astype(float), weight[by], key[by]
    falling = -c
    for sweep in range(first, first + SWEEPS):
        t = np.ones(len(by))
        n = len(by)
        for j in range(1, EXACT):
            n = int(np.searchsorted(falling[:n], -j, side="left"))  # dishes with over j customers
            if not n:
                break
            t[:n] += _uniform(k[:n], sweep, j) * (a[:n] + j - discount * t[:n]) < a[:n]
        n = int(np.searchsorted(falling[:n], -EXACT, side="left")) if n else 0
        j = EXACT
        while n:
            stop = np.minimum(2 * j, c[:n])
            free = a[:n] - discount * t[:n]
            t[:n] += np.minimum(_poisson(a[:n] * np.log((free + stop) / (free + j)), k[:n], sweep, j), stop - j)
            j *= 2
            n = int(np.searchsorted(falling[:n], -j, side="left"))
        tables[by] += t - 1
    return tables


@functools.cache
def stirling(discount: float) -> np.ndarray:
    """Logarithms of S_d(n, t) for n and t up to ``STIRLING``."""
    out = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, STIRLING + 1)
    for n in range(STIRLING):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(0.0, n - discount * t))
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay + out[n, 1:])
    return out


def _normal(key: np.ndarray, stream: int, number: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_uniform(key, stream, number))) * np.cos(2 * np.pi * _uniform(key, stream, number + 1))


def _gamma(shape: np.ndarray, key: np.ndarray, stream: int) -> np.ndarray:
    """Gamma variates (Marsaglia and Tsang); those of shape zero are zero."""
    out = np.zeros(len(shape))
    left = np.flatnonzero(shape > 0)
    small = left[shape[left] < 1]
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    for tries in range(0, 300, 3):
        if not len(left):
            break
        k, dd = key[left], d[left]
        z = _normal(k, stream, tries)
        v = (1 + z / np.sqrt(9 * dd)) ** 3
        good = v > 0
        v = np.where(good, v, 1.0)
        good &= np.log(_uniform(k, stream, tries + 2)) < z * z / 2 + dd * (1 - v + np.log(v))
        out[left[good]] = (dd * v)[good]
        left = left[~good]
    out[small] *= _uniform(key[small], stream, 300) ** (1 / shape[small])
    return out


def _many_tables(n: np.ndarray, a: np.ndarray, discount: float, key: np.ndarray, stream: int) -> np.ndarray:
    """Tables of dishes with many customers.

    a^t * S_d(n, t) is the law of the number of jumps of a compound Poisson sum with Sibuya jumps, given that
    the sum is n. Where a is small against n one jump takes nearly all, and the others are Poisson with mean
    a / d; elsewhere t is nearly normal, with moments at the saddle point x of a * x * (1 - x)^(d - 1) = n.
    """
    low, high = np.zeros(len(n)), np.full(len(n), 700.0)
    for _ in range(60):  # y = -log(1 - x)
        y = (low + high) / 2
        over = np.log(a) + np.log(-np.expm1(-y)) + (1 - discount) * y > np.log(n)
        low, high = np.where(over, low, y), np.where(over, y, high)
    rest = np.exp(-discount * y)
    mean = a / discount * (1 - rest)
    first = n / mean  # moments of a jump
    second = first * (1 + (1 - discount) * np.expm1(y))
    normal = np.round(mean + np.sqrt(np.maximum(0.0, mean * (1 - first * first / second))) * _normal(key, stream, 10))
    jumps = 1 + _poisson(a / discount, key, stream, 20)
    few = ((a / n) ** (discount / (1 - discount)) < 1e-3) | (a / discount < 10)
    return np.clip(np.where(few, jumps, normal), 1, n)


@functools.cache
def steps(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """S_d(n, t + 1) / S_d(n, t) by n and t: logarithms, and the ratios themselves."""
    with np.errstate(invalid="ignore"):
        logs = np.nan_to_num(np.diff(stirling(discount), axis=1), nan=-np.inf, posinf=0.0, neginf=-np.inf)
    return logs, np.exp(logs)


def gibbs_tables(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, stream: int) -> np.ndarray:
    """Tables t of each dish (1 customer at least), drawn with odds ``weight``^t * S_d(customers, t)."""
    tables = np.ones(len(customers))
    more = np.flatnonzero(customers > 1)
    by = more[np.argsort(customers[more].astype(np.int64), kind="stable")]
    c, a, k = customers[by].astype(np.int64), np.maximum(weight[by], 1e-300), key[by]
    u = _uniform(k, stream, 0)
    drawn = np.ones(len(by))
    two, many = np.searchsorted(c, 3), np.searchsorted(c, STIRLING + 1)
    drawn[:two] += u[:two] * (a[:two] + 1 - discount) < a[:two]
    if many < len(c):
        drawn[many:] = _many_tables(c[many:].astype(float), a[many:], discount, k[many:], stream)
    (logs, ratios), log_a = steps(discount), np.log(a)
    for i in range(two, many, ROWS):
        rows = slice(i, min(many, i + ROWS))
        # odds fall off faster for fewer customers and smaller weights, so beyond `last` no row has odds that a double adds to its sum
        n, top = int(c[rows].max()), float(log_a[rows].max())
        reach = np.concatenate(([0.0], np.cumsum(logs[n, 1:n] + top)))
        last = int(np.flatnonzero(reach > reach.max() - 45)[-1]) + 1
        odds = np.zeros((rows.stop - i, last))
        if reach.max() < 600:  # products stay within a double's range; those that fall out below count for nothing
            odds[:, 0] = 1
            low = int(c[i])
            each = np.ascontiguousarray(ratios[low: n + 1, 1:last]).take(c[rows] - low, axis=0)
            each *= a[rows, None]
            np.cumprod(each, axis=1, out=odds[:, 1:])
        else:
            np.cumsum(logs[c[rows], 1:last] + log_a[rows, None], axis=1, out=odds[:, 1:])
            np.exp(odds - odds.max(axis=1, keepdims=True), out=odds)
        cdf = np.cumsum(odds, axis=1, out=odds)
        drawn[rows] += np.count_nonzero(cdf < u[rows, None] * cdf[:, -1:], axis=1)
    tables[by] = drawn
    return tables


class State(NamedTuple):
    """What a sweep left: its number, the answers' path, and customers, tables and gamma variates of the parent and tables after the start."""

    sweep: int
    path: str | None = None
    customers: float = 0.0
    own: float = 0.0
    start: float = 0.0
    gammas: float = 0.0


class Words:
    """What a chunk knows of its words: their hashes, counts, and how often each is a context (the start last)."""

    def __init__(self, chunk: int, words: np.ndarray, count: np.ndarray, n: float, v: float):
        self.chunk, self.words, self.count, self.n, self.v = chunk, words, count, n, v
        self.context = np.append(count, float(count[np.searchsorted(words, END)]))  # each document has one start and one end
        self.base = (count + 1) / (n + v + 1)

    def parent(self, state: State, last: bool = False):
        """After a sweep: tables of each context, the parent's probability of each word, and the weights that the next sweep (if it isn't the ``last``) draws for both."""
        if state.path is None:  # estimates, before any customer sits
            tables = self.context ** DISCOUNT
            return tables, self.base, STRENGTH + DISCOUNT * tables, self.base
        got = [x for _, x in answers_of(state.path, self.chunk)]
        tables, customers, own = (np.concatenate([unpack_ints(x[k]) for x in got]).astype(float) for k in range(3))
        tables = np.append(tables, state.start)
        g = np.where(self.count > 0, (1 - UNKNOWN) / max(1.0, self.v), UNKNOWN if self.v else 1.0)
        free = ROOT_STRENGTH + ROOT_DISCOUNT * state.own
        p = (customers - ROOT_DISCOUNT * own + free * g) / (ROOT_STRENGTH + state.customers)
        if last:
            return tables, p, None, None
        drawn = DISCOUNT * _gamma(STRENGTH / DISCOUNT + tables, np.append(self.words, START), CONTEXT_STREAM + state.sweep)
        rest = _gamma(np.array([free]), ROOT, WORD_STREAM + state.sweep)[0]
        q = (_gamma(customers - ROOT_DISCOUNT * own, self.words, WORD_STREAM + state.sweep) + rest * g) / (state.gammas + rest)
        return tables, p, drawn, q


def tables_of(state: State, drawn: np.ndarray, q: np.ndarray, u: np.ndarray, w: np.ndarray, pairs: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables of bigrams (``pairs`` customers each, 1 at least) in the sweep after ``state``."""
    weight = drawn[u] * q[w]
    if state.path is None:
        return np.maximum(1, np.round(seat(pairs, weight, DISCOUNT, key, 0) / SWEEPS))
    return gibbs_tables(pairs, weight, DISCOUNT, key, SWEEPS + state.sweep)


def counted(counts: str, chunk: int, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of the chunk's words and bigrams, and which bigrams it draws."""
    got = [x for _, x in answers_of(counts, chunk)]
    count = np.concatenate([unpack_ints(x[0]) for x in got]).astype(float)
    pairs, owner = np.empty(len(c.key)), np.empty(len(c.key), dtype=bool)
    pairs[c.by] = np.concatenate([unpack_ints(x[1]) for x in got])
    owner[c.by] = np.concatenate([np.unpackbits(x[2], count=x[1][0]).astype(bool) for x in got])
    return count, pairs, owner


def _seats(counts: str):
    """Of each chunk: its words with their totals, and the bigrams that it draws with theirs."""

    def work(chunk, packed):
        c = Chunk(packed)
        count, pairs, owner = counted(counts, chunk, c)
        own = np.flatnonzero(owner & (pairs > 0))
        u = np.diff(c.u[own], prepend=0)
        kept = dump((c.words, pack_ints(count), pack_ints(u), pack_ints(c.w[own]), pack_ints(pairs[own])))
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([kept], pa.binary())], ["chunk", "size", "payload"])

    return work


def _ask_tables(shards: int, n: float, v: float, last: State):
    def ask(chunk, kept):
        words, count, u, w, pairs = kept
        m = Words(chunk, words, unpack_ints(count).astype(float), n, v)
        u, w, pairs = np.cumsum(unpack_ints(u)).astype(np.int64), unpack_ints(w).astype(np.int64), unpack_ints(pairs).astype(float)
        t = tables_of(last, *m.parent(last)[2:], u, w, pairs, keys_of(words, u, w))
        opened = np.bincount(u, weights=t, minlength=len(words) + 1)
        sent = np.bincount(w, weights=t, minlength=len(words))
        a = np.searchsorted(to_shards(words, shards), np.arange(shards + 1))
        for k in range(shards):
            i = slice(a[k], a[k + 1])
            yield k, (words[i], pack_ints(opened[:-1][i]), pack_ints(sent[i]), float(opened[-1]) if k == 0 else 0.0)

    return ask


def _answer_tables(v: float, last: State):
    def answer(asked):
        keys = [q[0] for _, q in asked]
        every, opened, which, _ = _totals(keys, [unpack_ints(q[1]).astype(float) for _, q in asked])
        sent = np.bincount(which, weights=np.concatenate([unpack_ints(q[2]) for _, q in asked]).astype(float), minlength=len(every))
        own = np.zeros(len(every))
        at = np.flatnonzero(sent > 0)
        tables = v if last.path is None else last.own
        drawn = ROOT_DISCOUNT * _gamma(np.array([ROOT_STRENGTH / ROOT_DISCOUNT + tables]), ROOT, CONTEXT_STREAM + last.sweep)[0]
        own[at] = gibbs_tables(sent[at], np.full(len(at), drawn * (1 - UNKNOWN) / max(1.0, v)), ROOT_DISCOUNT, every[at], ROOT_STREAM + last.sweep)
        gammas = _gamma(sent - ROOT_DISCOUNT * own, every, WORD_STREAM + last.sweep + 1).sum()
        cut = np.cumsum([len(k) for k in keys])[:-1]
        parts = [np.split(x[which], cut) for x in (opened, sent, own)]
        return [(-1, (float(sent.sum()), float(own.sum()), float(sum(q[3] for _, q in asked)), float(gammas))), *((chunk, tuple(pack_ints(p[k]) for p in parts)) for k, (chunk, _) in enumerate(asked))]

    return answer


def predictive(m: Words, u: np.ndarray, w: np.ndarray, pairs: np.ndarray, key: np.ndarray, states: list[State]) -> np.ndarray:
    """Probability of word ``w`` after word ``u``, averaged over the sweeps that led from each state to the next."""
    some = np.flatnonzero(pairs > 0)
    own = u[some], w[some], pairs[some], key[some]
    prob, seated, share = np.zeros(len(pairs)), np.zeros(len(pairs)), 1 / (STRENGTH + m.context)
    before = m.parent(states[0])
    for last, state in zip(states, states[1:]):
        seated[some] = tables_of(last, *before[2:], *own)
        tables, p, *_ = before = m.parent(state, state is states[-1])
        rest = np.where(m.context > 0, (STRENGTH + DISCOUNT * tables) * share, 1.0)  # of the parent's probability; a context that has no customers gives it whole
        prob += (pairs - DISCOUNT * seated) * share[u] + rest[u] * p[w]
    prob /= len(states) - 1
    return prob


def _finish(counts: str, n: float, v: float, states: list[State]):
    def work(chunk, packed):
        c = Chunk(packed)
        count, pairs, _ = counted(counts, chunk, c)
        m = Words(chunk, c.words, count, n, v)
        prob = predictive(m, c.u, c.w, pairs, c.key, states)
        docs = len(c.ids)
        known = np.bincount(c.doc, weights=count[c.token] > 0, minlength=docs).astype(np.int64)
        base = np.bincount(c.doc, weights=np.log10(m.base)[c.token], minlength=docs)
        score = np.bincount(c.doc, weights=np.log10(prob)[c.bigram], minlength=docs)
        yield pa.RecordBatch.from_arrays([
            pa.array(c.ids, pa.int64()), pa.array(c.out), pa.array(c.lengths, pa.int64()), pa.array(known),
            pa.array(np.full(docs, int(n)), pa.int64()), pa.array(base), pa.array(score), pa.array(10 ** (-score / c.lengths)),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return work


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    spark = docs.sparkSession
    store = chunk_store(docs, id_col, text_col, _pack, "lm-chunks", target=8_000_000)
    shards = shards_for(store, PER_SHARD)

    def trained(chunk, packed):
        ids, lengths, _, _ = packed
        n = sum(int(k) for i, k in zip(ids, lengths) if not held_out_id(i))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    n = float(sum(r[0] for r in over_chunks(store, trained, "n long").groupBy().sum("n").collect() if r[0] is not None))
    counts = exchange(store, _ask_counts(shards), _answer_counts, "lm-counts", shards)
    v = summed(spark, counts, 1)[0]
    seats = materialise(over_chunks(store, _seats(counts), STORE), "lm-seats", "zstd")
    states = [State(0)]
    for sweep in range(1, rounds + SWEEPS + 1):
        path = exchange(seats, _ask_tables(shards, n, v, states[-1]), _answer_tables(v, states[-1]), "lm-tables", shards)
        states.append(State(sweep, path, *summed(spark, path, 4)))
        if 1 < sweep <= rounds:  # nothing reads the burn-in's tables but the next sweep
            discard_path(spark, states[sweep - 1].path)
    discard(seats)
    return over_chunks(store, _finish(counts, n, v, states[rounds:]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
