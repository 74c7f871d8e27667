import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lumenbridge.llm import exact_dedup, exchange, simhash, suffix_dedup
from lumenbridge.llm.common import TO_LOWER


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("ranges", [8, 1, 1000])
def test_exact(docs, rows, ranges):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, stayed = min(known, default=None), False
        for i in ids:
            kept = i == keep and not stayed
            stayed |= kept
            want.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    same(exact_dedup.exact_dedup(docs, per_partition=ranges).collect(), want)


def test_exact_copies_over_many_ranges(spark):
    """A third of the rows share one text, some of them their id too or none; texts share long beginnings."""
    rows = [(i % 7 if i < 400 else None, "same  text") for i in range(600)] + [(1000 + i, "x" * 70 + str(i % 40)) for i in range(600)] + [(2000 + i, "y" * 2000 + " z" * i) for i in range(300)] + [(5000, "long " * 100_000)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(" +", " ", t)].append(i)
    got = exact_dedup.exact_dedup(df, per_partition=30).collect()
    want = {hashlib.sha256(t.encode()).hexdigest(): (min(i for i in ids if i is not None), len(ids)) for t, ids in groups.items()}
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got) and len(got) == len(rows)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(want) and all(r.doc_id == r.keep_id for r in got if r.kept)
    cuts = exact_dedup.splitters(df, "text", 240)
    assert max(c[2] for c in cuts) > 30 and all(len(t) <= exact_dedup.LAST or k > 1 for t, _, k in cuts)


def test_exact_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().translate(TO_LOWER).split()
    shingles = [b" ".join(words[k: k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in root}


@pytest.mark.parametrize("pairs", [24, 1])
def test_simhash(docs, rows, pairs, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    root = brute_components({f for _, f in fps})
    low = {}
    for i, f in fps:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    want = [(i, simhash._signed(f), low.get(root[f])) for i, f in fps]
    same(simhash.near_dedup(docs).collect(), want)


@pytest.mark.parametrize("pairs", [24, 2])
def test_links_of_a_large_near_group(spark, pairs, monkeypatch):
    """Chains and stars of fingerprints one and two bits apart, by both ways."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 1 << 63, 40).tolist())
    for f in list(fps)[:6]:
        for _ in range(40):
            g = f
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                g ^= 1 << b
            fps.add(g)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {simhash._signed(f): simhash._signed(f) for f in fps}
    got |= {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(fps)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(got) == groups({simhash._signed(k): simhash._signed(v) for k, v in want.items()})


def test_simhash_empty(none):
    assert simhash.near_dedup(none).count() == 0


def test_drop_near_copies_keeps_one_of_each(docs, rows):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    root = brute_components({brute_fingerprint(r[1]) for r in rows})
    left = [root[brute_fingerprint(r.text)] for r in kept.collect()]
    assert sorted(left) == sorted(set(root.values()))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n in [*range(12), 50, 51, 52, 200]:
        for top in (2, 4, 250):
            s = rng.integers(1, top, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def brute_removed(texts, length=200):
    seen = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk, batch, hot, fan", [(6_000_000, 1_000_000, 3000, 1000), (2_000, 500, 3000, 1), (3_000, 400, 1, 1000), (3_000, 400, 1, 1)])
def test_suffix_dedup(docs, rows, chunk, batch, hot, fan, monkeypatch):
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PER_SHARD", 20_000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1_000_000 if chunk > 10_000 else 700)
    monkeypatch.setattr(exchange, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup.chunk_store, "__defaults__", (chunk,))
    want = [(r[0], *x) for r, x in zip(rows, brute_removed([(r[1] or "").encode() for r in rows]))]
    same(suffix_dedup.dedup(docs).collect(), want)


def test_suffix_chunks_pass_the_jvm_one_by_one(spark, monkeypatch):
    """A task's chunks are row groups of their own, and passes over them bring the JVM no payload."""
    import pyarrow.parquet as pq

    made = []
    monkeypatch.setattr(suffix_dedup.chunk_store, "__defaults__", (2_000,))
    monkeypatch.setattr(suffix_dedup, "chunk_store", lambda *a, f=suffix_dedup.chunk_store, **b: made.append(f(*a, **b)) or made[0])
    texts = [f"{i} " * 300 for i in range(40)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    same(suffix_dedup.dedup(df).collect(), [(i, *x) for i, x in enumerate(brute_removed([t.encode() for t in texts]))])
    groups = []
    for path in made[0].inputFiles():
        with pq.ParquetFile(path.removeprefix("file://")) as file:
            groups += [file.metadata.row_group(k).num_rows for k in range(file.num_row_groups)]
    assert len(groups) >= 10 and set(groups) == {1}
    assert "payload" not in made[0].columns


def test_suffix_empty(none):
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 64])
@pytest.mark.parametrize("hot", [3000, 2])
def test_suffix_dedup_when_hashes_collide(rows, hot, bits, monkeypatch):
    """Hashes of contexts and windows only tell which bytes to compare: with hashes of few bits the result is the same."""
    sd, own = suffix_dedup, suffix_dedup.Prefix.of
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "BATCH", 5_000)
    monkeypatch.setattr(sd.Prefix, "of", lambda self, b, e: own(self, b, e) & np.uint64((1 << bits) - 1))
    answers = {}
    monkeypatch.setattr(sd, "answers_of", lambda path, chunk: answers[path].get(chunk, []))
    texts = [(r[1] or "").encode() for r in rows]
    packed = {k: sd._pack(list(range(k, len(texts), 3)), texts[k::3])[1] for k in range(3)}

    def passed(ask, answer, path):
        asked, answers[path] = {}, {}
        for chunk, x in packed.items():
            for shard, q in ask(chunk, x):
                asked.setdefault(shard, []).append((chunk, q))
        for shard, q in sorted(asked.items()):
            for chunk, x in answer(q):
                answers[path].setdefault(chunk, []).append((shard, x))

    passed(sd._ask_contexts(4), sd._judge, "first")
    passed(sd._ask_texts("first", 4), sd._compare, "second")
    passed(sd._ask_windows("first", "second", 4), sd._sort_windows, "third")
    got = [tuple(r.values()) for k, x in packed.items() for b in sd._finish("second", "third")(k, x) for r in b.to_pylist()]
    assert (answers["third"] != {}) == (hot == 2)
    assert Counter(got) == Counter((i, *w) for i, w in enumerate(brute_removed(texts)))
