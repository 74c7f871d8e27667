import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenbridge.llm import mixing, token_output


def brute_copies(rows, alpha=mixing.ALPHA, seed=mixing.SEED):
    n = Counter(r[3] for r in rows)
    w = {s: k ** alpha for s, k in n.items()}
    rate = {s: w[s] * len(rows) / (sum(w.values()) * n[s]) for s in n}
    out = Counter()
    for r in rows:
        u = int(hashlib.md5(f"{seed}:{hashlib.md5((r[1] or '').encode()).hexdigest() if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, term, cdf = 0, math.exp(-rate[r[3]]), math.exp(-rate[r[3]])
        while cdf <= u:
            k += 1
            term *= rate[r[3]] / k
            cdf += term
        out[r[:2]] += k
    return +out


@pytest.mark.parametrize("few", [2_000_000, 1])
def test_mixing(docs, rows, few, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", few)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == brute_copies(rows)
    keys = [r.shuffle_key for r in got]
    assert keys == sorted(keys)


def test_mixing_to_given_weights(spark, docs, none):
    rows = spark.createDataFrame([(i, "ab"[i % 10 > 6]) for i in range(20_000)], "doc_id long, source string")
    n = {r.source: r["count"] for r in mixing.mix(rows, {"a": 1, "b": 3}).groupBy("source").count().collect()}
    assert abs(n["a"] - 5_000) < 300 and abs(n["b"] - 15_000) < 500
    assert mixing.mix(docs, {"absent": 1}).count() == 0 and mixing.mix(none).count() == 0


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        counts = (rng.pareto(0.5, n) * 10).astype(np.int64) + 1
        for limit in (10, 20):
            lengths = token_output.code_lengths(counts, limit)
            assert lengths.max() <= limit and (n == 1 or np.sum(0.5 ** lengths) == 1)
        if n > 1:  # unlimited enough: as good as Huffman's own
            import heapq
            heap = counts.tolist()
            heapq.heapify(heap)
            cost = 0
            while len(heap) > 1:
                a = heapq.heappop(heap) + heapq.heappop(heap)
                cost += a
                heapq.heappush(heap, a)
            deep = token_output.code_lengths(counts, 40)
            assert int((counts * deep).sum()) == cost
    with pytest.raises(ValueError):
        token_output.code_lengths(np.ones(1025, dtype=np.int64), 10)


def test_codebook_round_trip():
    rng = np.random.default_rng(2)
    docs = [rng.zipf(1.3, n).clip(max=60_000).astype(np.uint32) for n in (1, 127, 128, 129, 5000)]
    every, counts = np.unique(np.concatenate(docs), return_counts=True)
    book = token_output.Codebook(every, token_output.code_lengths(counts))
    for d, payload, marks in zip(docs, *book.encode(docs)):
        sizes = np.full(len(marks), token_output.EVERY)
        sizes[-1] = len(d) - (len(marks) - 1) * token_output.EVERY
        assert (book.decode(payload, marks, sizes) == d).all()


ODD = ["<|endoftext|> is <|STARTOFTEXT|>", "a\x1cb\x85c\u2003d", "İstanbul ΣΑΣ ﬁ e\u0301", "it's THE we'll 12½ ² _x_ don't", "日本語 テスト", "\x00\x7f", "Ünïcode Straße × ÷"]


def test_tokens_equal_the_library(spark, rows, none, tmp_path, monkeypatch):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "BLOCK_IDS", 300)
    monkeypatch.setattr(token_output, "RANGE_IDS", 1500)
    rows = [(r[0], r[1]) for r in rows] + [(2000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = Tokenizer.from_file(token_output.default_tokenizer())
    ids = [(r[0], np.array(own.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")) for r in rows]
    got = token_output.token_output(df, str(tmp_path / "tokens")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    before, order = 0, sorted(got, key=lambda r: r.start)
    for r in order:
        assert r.start == before
        before += r.n_tokens
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known) and order[-1].doc_id is None
    assert spark.read.parquet(str(tmp_path / "tokens/blocks")).count() > 10
    assert token_output.token_output(none, str(tmp_path / "nothing")).count() == 0


def test_long_texts_repeats_and_nulls_over_several_parts(spark, tmp_path, monkeypatch):
    """A text over a block's size; rows of one id, and of none, which fill many parts."""
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_output.default_tokenizer())
    rows = [(1, "one two " * 150_000)] + [(5, f"five {i} " * 40) for i in range(300)] + [(None, "none " * 50)] * 200 + [(7, "tail")]
    monkeypatch.setattr(token_output, "RANGE_IDS", 2_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS part", "1 AS tie", "2 AS salt").repartition(4)
    ids = {t: np.array(own.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for t in {r[1] for r in rows}}
    assert len(ids[rows[0][1]]) > token_output.BLOCK_IDS
    want = Counter((i, len(ids[t]), zlib.crc32(ids[t].tobytes())) for i, t in rows)
    for keep in (False, True):
        path = str(tmp_path / f"tokens{keep}")
        got = sorted(token_output.token_output(df, path, keep_order=keep).collect(), key=lambda r: r.start)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])))[:-1].tolist()
    blocks = spark.read.parquet(str(tmp_path / "tokensFalse/blocks")).collect()
    by_doc = {}
    for b in blocks:
        for i, null in zip(np.frombuffer(b.doc_ids, dtype="<i8"), b.doc_null):
            by_doc.setdefault(None if null else int(i), set()).add(b.part)
    assert len(by_doc[5]) > 3 and len(by_doc[None]) > 2


def test_kept_order_is_the_inputs(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(i * 7 % 50, f"word {i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    got = sorted(token_output.token_output(df, str(tmp_path / "t"), keep_order=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i * 7 % 50 for i in range(50)]
