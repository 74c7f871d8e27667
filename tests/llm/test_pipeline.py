"""The pipeline's stages against brute force, and the queries' SQL, on the smallest tables."""

import os
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lumenbridge.llm import queries

from .test_dedup import brute_components, brute_fingerprint
from .test_output import brute_copies
from .test_scoring import brute_hits

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in "documents benchmark pages".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got, want = queries.queries()[name](spark, DATA), db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    order = [columns.index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def test_stages_and_their_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "decontaminate", "mixing", "token_output"]


def test_pipeline(spark, db):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from lumenbridge.llm import token_output

    rows = db.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]  # no text here is in doubt between languages
    fps = [brute_fingerprint(r[1]) for r in rows]
    root, low = brute_components(set(fps)), {}
    for r, f in zip(rows, fps):
        low[root[f]] = min(r[0], low.get(root[f], r[0]))
    rows = [r for r, f in zip(rows, fps) if r[0] == low[root[f]]]
    dirty = {k[0] for k in brute_hits(rows, db.execute("SELECT item_id, text FROM benchmark").fetchall()) if k[5]}
    rows = [r for r in rows if r[0] not in dirty]
    own = Tokenizer.from_file(token_output.default_tokenizer())
    want = Counter()
    for (doc, text), n in brute_copies(rows).items():
        import numpy as np

        ids = np.array(own.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += n
    got = corpus_pipeline.run(spark, DATA).collect()
    assert dirty and Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def staged(spark, docs, tmp_path):
    """All stages over a table of our own, beside the driver's benchmark."""
    folder = str(tmp_path / "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    os.symlink(f"{DATA}/benchmark.parquet", f"{folder}/benchmark.parquet")
    found, rows = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, folder)
        if k < 4:
            assert rows.columns == docs.columns, name
            rows.write.parquet(str(tmp_path / name))
            rows = spark.read.parquet(str(tmp_path / name))
        found.append(rows.count())
    return found, rows, corpus_pipeline.run(spark, folder)


def test_stages_of_an_empty_table(spark, none, tmp_path):
    pytest.importorskip("public_tokenizers")
    found, rows, ran = staged(spark, none, tmp_path)
    assert found == [0] * 5 and ran.count() == 0 and ran.columns == rows.columns


def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    known = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [*known, *known[:5], *known[:5], (None, known[7][1], None, None, None), (None, None, None, None, None), (-1, "", "en", None, 0), (-2, "!!! ...", None, "x", 7), (-3, known[9][1] * 40, "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"7 AS `{c}`" for c in ("fp", "root", "best", "top", "letters", "n_copies", "copy_no", "shuffle_key", "_own", "c0", "c1", "n_words", "spans", "gone_id")])
    found, rows, ran = staged(spark, docs, tmp_path)
    assert all(found) and found[1] < found[0] < len(known) + 15
    first = spark.read.parquet(str(tmp_path / "language_id"))
    assert first.filter("doc_id IN (-1, -2) OR text IS NULL").count() == 0
    assert spark.read.parquet(str(tmp_path / "simhash")).groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    digests = rows.collect()
    assert Counter(r.doc_id for r in digests) == Counter(r.doc_id for r in mixed.collect())
    digests.sort(key=lambda r: r.start)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(digests, digests[1:])) and digests[0].start == 0
    ids = [r.doc_id or 0 for r in digests]
    assert ids != sorted(ids)  # the files keep the shuffled order
    assert ran.count() == len(digests)
