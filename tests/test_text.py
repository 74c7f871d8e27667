import hashlib

import pytest
from pyspark.sql import functions as F

from lumenbridge.functions import text as T


@pytest.mark.parametrize("descriptor, mention, want", [
    ("Butyrates", "butyrate production", True), ("Interleukin-6", "IL-6", False), ("Rats", "cell separation", True), ("Tumor Necrosis Factor-alpha", "TNF-α", False),
    ("Fatty Acids, Volatile", "volatile fatty acid", True), ("", "x", False), ("x", "", False),
])
def test_matching(spark, descriptor, mention, want):
    row = spark.createDataFrame([(descriptor, mention)], "d string, m string").select(T.matches(T.stems(F.col("d")), T.stems(F.col("m"))).alias("x")).first()
    assert row.x is want


@pytest.mark.parametrize("answer, ok, n", [
    ('{"relations": [{"subject": "a", "predicate": "b", "object": "c", "evidence": ""}]}', True, 1), ("no JSON", False, 0), ('{"relations": "none"}', False, 0), ('{"relations": []}', True, 0),
    ('```json\n{"relations": [{"subject": "a", "predicate": " ", "object": "c"}]}\n```', True, 0), ('{"relations": [5, "w", null, ["x"], {"subject": "a", "predicate": "b", "object": "c"}, {"subject": "a"}]}', True, 1), ('{"relations": []} trailing', False, 0), ('{"relations": []}, {"relations": []}', False, 0), ('[]', False, 0),
    ('```json {"relations": []}```', False, 0), ('{"relations": [{"subject": null, "predicate": "b", "object": "c"}]}', True, 0), (None, False, 0),
])
def test_answers(spark, answer, ok, n):
    found, parse_ok = T.parse_relations(F.col("a"))
    row = spark.createDataFrame([(answer,)], "a string").select(F.size(found).alias("n"), parse_ok.alias("ok")).first()
    assert (row.ok, row.n) == (ok, n)


def test_hashes(spark):
    row = spark.createDataFrame([("T", " body ")], "t string, a string").select(T.prompt_hash("m", "0.0", T.build_prompt(F.col("t"), F.col("a")), "v9").alias("h"), T.request_key(F.lit("search"), F.lit("{}")).alias("k")).first()
    prompt = f"{T.INSTRUCTIONS}\n\nTitle: T\nAbstract: body"
    assert row.h == hashlib.sha256("".join(x + "\0" for x in ("m", "v9", "t=0.0", prompt)).encode()).hexdigest()
    assert row.k == hashlib.sha256(b"search|{}").hexdigest()


def test_forms_and_hints(spark):
    row = spark.createDataFrame([("Aspirin", ["ASPIRIN", " Acid ", "acid", ""], " a ;; b")], "d string, s array<string>, h string").select(T.dedupe_forms(F.col("d"), F.col("s")).alias("f"), T.split_hints(F.col("h")).alias("h")).first()
    assert (row.f, row.h) == (["Aspirin", "Acid"], ["a", "b"])


def test_keys_of_requests():
    params = {"term": "a b", "retmax": 5, "db": "x"}
    assert T.sorted_json(params) == '{"db": "x", "retmax": 5, "term": "a b"}'
    assert hashlib.sha256(("search|" + T.sorted_json(params)).encode()).hexdigest() == "87ac5378fd33b6546fee8d3b11af6e6750c4ad7788e7988572cf75caef465e35"
