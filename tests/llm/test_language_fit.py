"""The pipeline's language stage on texts of no learned language, trained on the driver's tables."""

import os

import pytest

from lumenbridge.llm import language_id

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")

FOREIGN = [
    "Быстрая коричневая лиса прыгает через ленивую собаку у реки", "今日は天気がいいので公園を散歩しました", "Szybki brązowy lis przeskakuje nad leniwym psem",
    "xkcd qwrtz bvnm plkj hgfd zxcv bnmq wrtp", "#### ---- a |||| ==== $$$$ %%%%", "~~~~ {{{ x }}} ;;;",
]


def test_unlearned_languages_and_junk_go_and_others_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r[0] for r in language_id.keep_identified(docs.unionByName(odd)).select("doc_id").collect()}
    assert not kept & {-1 - i for i in range(len(FOREIGN))}
    assert kept == {r.doc_id for r in docs.collect() if r.text and language_id.LETTER.search(r.text)}
