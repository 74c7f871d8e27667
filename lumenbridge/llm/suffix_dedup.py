"""Suffix-array dedup: bytes of any 200-byte string that starts more than once.

1. *Anchors.* Every 200-byte window is filed under the smallest hash among its
   64-grams (the leftmost of equal ones). Equal windows have the same smallest
   64-gram at the same offset, so only windows under one anchor hash can be
   equal. Runs of windows under one anchor occurrence are its *context*.
2. *First exchange.* A chunk sends each of its different contexts once, with
   the number of its copies, to the shard of its anchor hash. An anchor met once
   in all holds no repeat. The others are asked for. Nothing is removed yet:
   hashes only tell which texts can't repeat.
3. *Second exchange: suffix arrays and comparisons.* The bytes of the contexts
   asked for go to shards of the anchor hash, each different one of a chunk
   once. Copies are compared byte by byte; a copy repeats in all its windows.
   Different contexts under one anchor are edges of longer repeats: a
   difference-cover suffix array (mod 3) of them is built: sampled triples are
   sorted and named, names are recursed on until they are unique, remaining
   suffixes are merged in, and 200-byte prefixes of neighbours are compared.
4. *Third exchange, for hot anchors only.* An anchor with over ``HOT`` different
   contexts (a passage in very many documents) isn't sorted in one shard. Its
   windows are spread by a hash of their 200 bytes; the bytes of those whose
   hash is met again are sorted in shards of that hash, neighbours compared.

All windows are judged on the input. Texts are never shuffled whole.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; very
long texts are a chunk of their own; repeats inside one document count,
overlapping ones too; repeated rows repeat each other; ids may be null; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import discard_path, table
from .exchange import answers_of, chunk_store, exchange, mix64, over_chunks, shards_for, summed, to_shards

LENGTH, GRAM = 200, 64
#: Different contexts under a hash beyond which its windows are spread by their own hash.
HOT = 3000
#: Bytes of input to a shard, and positions that are hashed at once (under 2**PLACE).
PER_SHARD, PIECE, PLACE = 16_000_000, 1_000_000, 21
#: Bytes of contexts that are sorted at once; contexts of one hash stay together.
BATCH = 1_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    size, step = 1, base
    while size < n:
        out[size: 2 * size] = out[: min(size, n - size)] * np.uint64(step)
        size, step = 2 * size, step * step % (1 << 64)
    return out


class Prefix:
    """Hashes of any stretch of a text from one running sum."""

    def __init__(self, text: np.ndarray):
        n = len(text) + 1
        self.sum = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[text] * _powers(_BASE, n)[:-1], dtype=np.uint64)))
        self.back = _powers(pow(_BASE, -1, 1 << 64), n)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[begin]) * self.back[begin])


def contexts(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, first window and number of windows of every context.

    ``bounds`` are the documents' ends in ``text``, from 0 on.
    """
    out = []
    for at in range(0, max(0, len(text) - LENGTH + 1), PIECE):
        part = text[at: at + PIECE + LENGTH - 1]
        n = len(part) - LENGTH + 1
        doc = np.searchsorted(bounds, np.arange(at, at + n), side="right").astype(np.int32)
        own = np.arange(at + LENGTH, at + LENGTH + n) <= bounds[doc]
        grams = _BYTE[part]
        k = 1
        while k < GRAM:
            grams = grams[:-k] * _STEP[k.bit_length()] + grams[k:]
            k *= 2
        grams = mix64(grams)
        packed = grams >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(grams), dtype=np.uint64)
        span, k = LENGTH - GRAM + 1, 1
        while 2 * k <= span:
            packed = np.minimum(packed[:-k], packed[k:])
            k *= 2
        if k < span:
            packed = np.minimum(packed[: len(packed) - (span - k)], packed[span - k:])
        anchor = (packed[:n] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        # runs of windows of one document under one anchor
        new = own.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~own[:-1] | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        stop = own.copy()
        stop[:-1] &= new[1:] | ~own[1:]
        last = np.flatnonzero(stop)
        if len(first):
            prefix = Prefix(part)
            whole = prefix.of(first, last + LENGTH)
            offset = (anchor[first] - first).astype(np.uint64)
            whole = mix64(whole ^ (offset << np.uint64(8) | (last - first + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
            out.append((grams[anchor[first]], whole, first + at, last - first + 1))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate((s.astype(np.int64), np.zeros(3, dtype=np.int64)))
    top = int(t.max()) + 1
    if top ** 3 >= 1 << 62:
        t = np.unique(t, return_inverse=True)[1].astype(np.int64)
        top = int(t.max()) + 1
    # sampled positions; one past the end closes the first half where n % 3 is 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    pair = t[sample] * top + t[sample + 1]
    third = t[np.minimum(sample + 2, n + 2)]
    if top ** 3 < 1 << 62:
        key = pair * top + third
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order]) != 0
    else:
        order = np.lexsort((third, pair))
        fresh = (np.diff(pair[order]) != 0) | (np.diff(third[order]) != 0)
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.concatenate(([0], np.cumsum(fresh))) + 1
    sorted_ = order if len(sample) and names.max() == len(sample) else suffix_array(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[sorted_]] = np.arange(1, len(sample) + 1)
    in_order = sample[sorted_]
    in_order = in_order[in_order < n]
    zero = np.arange(0, n, 3)
    wide = len(sample) + 2
    zero = zero[np.argsort(t[zero] * wide + rank[zero + 1], kind="stable")]
    ones, twos = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    before = np.searchsorted(t[ones] * wide + rank[ones + 1], t[zero] * wide + rank[zero + 1])
    if top * top * wide < 1 << 62:
        mine, theirs = (t[zero] * top + t[zero + 1]) * wide + rank[zero + 2], (t[twos] * top + t[twos + 1]) * wide + rank[twos + 2]
    else:
        both = np.unique(np.concatenate((t[zero] * top + t[zero + 1], t[twos] * top + t[twos + 1])), return_inverse=True)[1].astype(np.int64)
        mine, theirs = both[: len(zero)] * wide + rank[zero + 2], both[len(zero):] * wide + rank[twos + 2]
    before = before + np.searchsorted(theirs, mine)
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(zero))
    rest = np.ones(n, dtype=bool)
    rest[at] = False
    out[at], out[rest] = zero, in_order
    return out


def repeated_windows(text: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of ``windows`` (sorted starts in ``text``) equal another one, from neighbours in the suffix array."""
    mark = np.zeros(len(text) + 1, dtype=bool)
    mark[windows] = True
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[mark[order]]
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for k in (length - 1, *range(0, length - 1)):  # most differ at the end
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
    same = np.zeros(len(text) + 1, dtype=bool)
    same[a[live]] = same[b[live]] = True
    return same[windows]


def _pack(ids, texts):
    return sum(map(len, texts)), ([*ids], [len(x) for x in texts], b"".join(texts))


def _open(packed):
    ids, sizes, blob = packed
    return ids, np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))), np.frombuffer(blob, dtype=np.uint8)


def _split(keys: np.ndarray, shards: int, *arrays: np.ndarray):
    """(shard, arrays) with the rows of each shard in their order; anchors' hashes are small ones, so keys are mixed again."""
    to = to_shards(mix64(keys), shards)
    by = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[by], np.arange(shards + 1))
    for k in range(shards):
        if cut[k + 1] > cut[k]:
            yield k, tuple(a[by[cut[k]: cut[k + 1]]] for a in arrays)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first leads), and the number of each row's group in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new) - 1


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch, in a row."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _ask_contexts(shards: int):
    """Of each shard: anchor hashes, context hashes, copies and windows of the chunk's different contexts, and the places of all copies."""

    def ask(_, packed):
        _, bounds, text = _open(packed)
        h, c, s, w = contexts(text, bounds)
        order, group = _groups(h, c)
        n = np.bincount(group) if len(group) else np.zeros(0, dtype=np.int64)
        first = order[np.cumsum(n) - n]
        places, begin = s[order].astype(np.uint32), np.cumsum(n) - n
        for shard, (k,) in _split(h[first], shards, np.arange(len(first))):
            yield shard, (h[first[k]], c[first[k]], n[k].astype(np.uint32), w[first[k]].astype(np.uint8), places[_ragged(begin[k], n[k])])

    return ask


def _joined(asked, *which: int) -> list[np.ndarray]:
    return [np.concatenate([q[k] for _, q in asked]) for k in which]


def _judge(asked):
    """Contexts of a shard that can repeat, to those that hold them."""
    h, c, n = _joined(asked, 0, 1, 2)
    order, group = _groups(h, c)
    copies = np.empty(len(h), dtype=np.int64)
    copies[order] = np.bincount(group, weights=n[order])[group]
    by_h = _groups(h[order])[1]
    new = np.append(True, group[1:] != group[:-1])
    kinds = np.empty(len(h), dtype=np.int64)
    kinds[order] = np.bincount(by_h, weights=new)[by_h]
    asks, hot, at, out = (copies > 1) | (kinds > 1), kinds > HOT, 0, [(-1, (float((kinds > HOT).any()),))]
    for chunk, (h_, c_, n_, w_, s_) in asked:
        own = asks[at: at + len(h_)]
        if own.any():
            out.append((chunk, (h_[own], c_[own], n_[own], w_[own], s_[np.repeat(own, n_)], hot[at: at + len(h_)][own])))
        at += len(h_)
    return out


def _wanted(first: str, chunk: int, hot: bool):
    """The chunk's contexts that a first exchange asks for: of hot anchors, or of the others."""
    found = [x for _, x in answers_of(first, chunk)]
    if not found:
        return None
    h, c, n, w, s, is_hot = (np.concatenate([x[k] for x in found]) for k in range(6))
    own = is_hot == hot
    return (h[own], c[own], n[own].astype(np.int64), w[own].astype(np.int64), s[np.repeat(own, n)].astype(np.int64)) if own.any() else None


def _same(text: np.ndarray, begin: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of ``text`` equal others of the same sizes, byte by byte."""
    out = np.ones(len(begin), dtype=bool)
    for i in range(0, len(begin), 4096):
        k = slice(i, i + 4096)
        differ = text[_ragged(begin[k], size[k])] != text[_ragged(other[k], size[k])]
        at = np.cumsum(size[k]) - size[k]
        if len(at):
            out[k] = ~np.logical_or.reduceat(differ, at)
    return out


def _shipped(h, c, n, w, s, text):
    """Contexts with the places of their copies, split where a copy's bytes aren't the first one's (hashes that collide)."""
    group = np.repeat(np.arange(len(n)), n)
    first = s[np.cumsum(n) - n][group]
    odd = ~_same(text, s, first, w[group] + LENGTH - 1)
    if odd.any():
        key = np.where(odd, len(n) + np.arange(len(s)), group)
        order, number = _groups(key)
        s, group, n = s[order], group[order], np.bincount(number)
        take = group[np.cumsum(n) - n]
        h, c, w = h[take], c[take], w[take]
    return h, c, n, w, s


def _ask_texts(first: str, shards: int):
    """Bytes of contexts to shards of their anchor; of hot anchors, hashes of windows to shards of their own."""

    def ask(chunk, packed):
        _, _, text = _open(packed)
        questions: dict[int, list] = {}
        found = _wanted(first, chunk, False)
        if found:
            h, c, n, w, s = _shipped(*found, text)
            begin = np.cumsum(n) - n
            for shard, (k,) in _split(h, shards, np.arange(len(h))):
                at = _ragged(s[begin[k]], w[k] + LENGTH - 1)
                questions.setdefault(shard, [None, None])[0] = (h[k], c[k], n[k].astype(np.uint32), w[k].astype(np.uint8), s[_ragged(begin[k], n[k])].astype(np.uint32), text[at].tobytes())
        key, start = _hot_windows(first, chunk, text)
        if len(key):
            every, n = np.unique(key, return_counts=True)
            for shard, (k_, n_) in _split(every, shards, every, n):
                questions.setdefault(shard, [None, None])[1] = (k_, n_)
        yield from questions.items()

    return ask


def _hot_windows(first: str, chunk: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each window under a hot anchor."""
    found = _wanted(first, chunk, True)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    _, _, n, w, s = found
    start = np.sort(_ragged(s, np.repeat(w, n)))
    key = np.empty(len(start), dtype=np.uint64)
    for i in range(0, len(text), PIECE):  # running sums of a piece at a time
        a, b = np.searchsorted(start, (i, i + PIECE))
        if b > a:
            key[a:b] = Prefix(text[i: i + PIECE + LENGTH]).of(start[a:b] - i, start[a:b] - i + LENGTH)
    return key, start


def _compare(asked):
    """To each chunk: contexts that repeat whole (places and numbers of windows), single windows that repeat, and hashes of hot windows met again."""
    out: dict[int, list] = {}

    def give(chunk, kind, x):
        out.setdefault(chunk, [[], [], [], []])[kind].append(x)

    texts = [(chunk, q[0]) for chunk, q in asked if q[0]]
    if texts:
        text = np.frombuffer(b"".join(q[5] for _, q in texts), dtype=np.uint8)
        owner = np.repeat(np.arange(len(texts)), [len(q[0]) for _, q in texts])
        h, c, n, w, places = _joined(texts, 0, 1, 2, 3, 4)
        n, w = n.astype(np.int64), w.astype(np.int64)
        size = w + LENGTH - 1
        base, begin = np.cumsum(size) - size, np.cumsum(n) - n
        order, group = _groups(h, c)
        lead = order[np.flatnonzero(np.append(True, group[1:] != group[:-1]))][group]  # the first context of each row's group
        alike = (size[order] == size[lead]) & _same(text, base[order], base[lead], np.minimum(size[order], size[lead]))
        group = np.where(alike, group, group.max() + 1 + np.arange(len(group)))  # colliding hashes: a context of its own
        copies = np.zeros(int(group.max()) + 1, dtype=np.int64)
        np.add.at(copies, group, n[order])
        whole = np.empty(len(h), dtype=bool)
        whole[order] = copies[group] > 1
        # one of each different context, by anchor
        own = order[np.unique(group, return_index=True)[1]]
        own = own[np.argsort(h[own], kind="stable")]
        kinds = np.bincount(_groups(h[own])[1])
        own = own[np.repeat(kinds > 1, kinds)]
        last = np.flatnonzero(np.append(h[own][1:] != h[own][:-1], True)) + 1 if len(own) else np.zeros(0, dtype=np.int64)  # ends of the anchors' contexts
        filled, done = np.cumsum(size[own]), 0
        while done < len(own):
            upto = max(done, int(np.searchsorted(filled, (filled[done - 1] if done else 0) + BATCH)))
            end = int(last[min(len(last) - 1, np.searchsorted(last, upto, side="left"))])
            some, done = own[done:end], end
            m = size[some]
            inner = np.cumsum(m) - m
            part = text[_ragged(base[some], m)]
            number = np.repeat(np.arange(len(some)), w[some])
            inside = np.arange(len(number)) - np.repeat(np.cumsum(w[some]) - w[some], w[some])
            keep = repeated_windows(part, inner[number] + inside) & ~whole[some][number]  # contexts met twice are covered already
            at, to = places[begin[some]][number][keep].astype(np.int64) + inside[keep], owner[some][number][keep]
            for k in np.unique(to).tolist():
                give(texts[k][0], 2, at[to == k])
        for k, (chunk, q) in enumerate(texts):
            mine = whole[owner == k]
            if mine.any():
                give(chunk, 0, q[4][np.repeat(mine, q[2])].astype(np.int64))
                give(chunk, 1, np.repeat(q[3], q[2])[np.repeat(mine, q[2])].astype(np.int64))
    windows = [(chunk, q[1]) for chunk, q in asked if q[1]]
    if windows:
        key, n = _joined(windows, 0, 1)
        every, which = np.unique(key, return_inverse=True)
        again, at = np.bincount(which, weights=n)[which] > 1, 0
        for chunk, (k, _) in windows:
            mine = again[at: at + len(k)]
            if mine.any():
                give(chunk, 3, k[mine])
            at += len(k)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return [(chunk, tuple(np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in zip(found, kinds))) for chunk, found in out.items()]


def _ask_windows(first: str, second: str, shards: int):
    """Bytes of the hot windows whose hash is met again, each different one of a chunk once, and the places of all."""

    def ask(chunk, packed):
        again = [x[3] for _, x in answers_of(second, chunk) if len(x[3])]
        if not again:
            return
        _, _, text = _open(packed)
        key, start = _hot_windows(first, chunk, text)
        own = np.isin(key, np.concatenate(again))
        key, start = key[own], start[own]
        order, group = _groups(key)
        n = np.bincount(group)
        key, _, n, _, start = _shipped(key[order[np.cumsum(n) - n]], key[:len(n)], n, np.ones(len(n), dtype=np.int64), start[order], text)
        begin = np.cumsum(n) - n
        for shard, (k,) in _split(key, shards, np.arange(len(key))):
            yield shard, (n[k].astype(np.uint32), start[_ragged(begin[k], n[k])].astype(np.uint32), text[_ragged(start[begin[k]], np.full(len(k), LENGTH))].tobytes())

    return ask


def _sort_windows(asked):
    """Places of the windows that equal another one: the windows' bytes are sorted, neighbours compared."""
    rows = np.frombuffer(b"".join(q[2] for _, q in asked), dtype=np.uint8).reshape(-1, LENGTH)
    n = np.concatenate([q[0] for _, q in asked]).astype(np.int64)
    order = np.lexsort(rows.reshape(len(rows), -1, 8).view(">u8")[:, ::-1, 0].T)
    new = np.append(True, (rows[order][1:] != rows[order][:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    again = np.empty(len(rows), dtype=bool)
    again[order] = np.bincount(group, weights=n[order])[group] > 1
    out, at = [], 0
    for chunk, (k, places, _) in asked:
        mine = again[at: at + len(k)]
        if mine.any():
            out.append((chunk, places[np.repeat(mine, k)].astype(np.int64)))
        at += len(k)
    return out


def _finish(second: str, third: str | None):
    def work(chunk, packed):
        ids, bounds, text = _open(packed)
        reach = np.zeros(len(text) + 1, dtype=np.int32)  # +1 where windows begin to cover, -1 where they end

        def cover(begin, end):
            for at, by in ((begin, 1), (end, -1)):
                if len(at):
                    places, times = np.unique(at, return_counts=True)
                    reach[places] += by * times.astype(np.int32)

        for _, (s, w, single, _) in answers_of(second, chunk):
            cover(s, s + w + (LENGTH - 1))
            cover(single, single + LENGTH)
        for _, starts in answers_of(third, chunk) if third else ():
            cover(starts, starts + LENGTH)
        gone = np.cumsum(reach[:-1]) > 0
        sizes = np.diff(bounds)
        removed, spans, sums = [], [], []
        for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = gone[b:e]
            removed.append(int(own.sum()))
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            sums.append(hashlib.sha256((text[b:e][~own] if removed[-1] else text[b:e]).tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return work


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    store = chunk_store(docs, id_col, text_col, _pack, "suffix-chunks", by_file=True)
    shards = shards_for(store, PER_SHARD)

    first = exchange(store, _ask_contexts(shards), _judge, "suffix-anchors", shards, shards)
    second = exchange(store, _ask_texts(first, shards), _compare, "suffix-texts", shards, shards)
    any_hot = summed(docs.sparkSession, first, 1)[0]
    third = exchange(store, _ask_windows(first, second, shards), _sort_windows, "suffix-windows", shards, shards) if any_hot else None
    discard_path(docs.sparkSession, first)
    return over_chunks(store, _finish(second, third), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
