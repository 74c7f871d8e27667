import os

from pyspark.sql import functions as F

from lumenbridge import schemas
from lumenbridge.operators import relations, sampling, store
from lumenbridge.streaming.ingest import stream_new_files


def test_upsert_replace_and_log(spark, tmp_path):
    path, keys, order = str(tmp_path / "synonyms"), ["descriptor"], [F.desc("fetched_at")]
    for forms, day in ((["a"], "2020-01-01"), (["b"], "2020-01-02")):
        batch = spark.createDataFrame([("X", forms)], "descriptor string, forms array<string>").withColumn("fetched_at", F.to_timestamp(F.lit(day)))
        store.upsert(spark, path, batch, schemas.SYNONYMS, keys, order)
    assert [r.forms for r in store.open_table(spark, path, schemas.SYNONYMS).collect()] == [["b"]]
    log = str(tmp_path / "runs")
    assert not store.test_was_run(spark, log)
    store.log_run(spark, log, {"seed": 1}, "test", "2020")
    assert store.test_was_run(spark, log)


def test_insert_ignore(spark):
    have = spark.createDataFrame([("1", "A")], schemas.PAPER_CORRIDOR)
    new = spark.createDataFrame([("1", "A"), ("1", "C"), ("1", "C")], schemas.PAPER_CORRIDOR)
    assert [tuple(r) for r in store.insert_ignore(have, new, ["pmid", "corridor"]).collect()] == [("1", "C")]


def test_years_without_a_date_are_a_group(spark):
    p = spark.createDataFrame([("1", None), ("2", 2000), ("3", 2000)], "pmid string, pub_year int")
    assert [tuple(r) for r in sampling.papers_by_year(p).collect()] == [(None, 1), (2000, 2)]


def test_latest_extraction_and_source(spark):
    e = spark.createDataFrame([("1", "m", "a", "x", 1), ("1", "m", "b", '{"relations": [{"subject": "s", "predicate": "p", "object": "o"}]}', 1), ("1", "n", "z", "", 9)], "pmid string, model string, prompt_hash string, payload string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    source = relations.TableSource(e, "m").require()
    rows = source.relations_for(spark.createDataFrame([("1",), ("2",)], "pmid string")).collect()
    assert [(r.pmid, [(x.subject, x.object) for x in r.relations]) for r in rows] == [("1", [("s", "o")])]


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([("1", "A"), ("1", "A"), ("2", "C")], schemas.PAPER_CORRIDOR)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream_new_files(spark, source, target, schemas.PAPER_CORRIDOR, mark, ["pmid", "corridor"])
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == [("1", "A"), ("2", "C")]


def test_a_stopped_replacement_is_read_and_settled(spark, tmp_path, monkeypatch):
    path, frame = str(tmp_path / "t"), lambda *x: spark.createDataFrame([(i, "A") for i in x], schemas.PAPER_CORRIDOR)
    store.replace(frame("1"), path)
    with monkeypatch.context() as m:  # the run stops right after its commit
        own, calls = store.settle, []
        m.setattr(store, "settle", lambda s, p: own(s, p) if not calls.append(1) and len(calls) == 1 else None)
        store.replace(frame("2", "3"), path)
    read = lambda: sorted(r.pmid for r in store.open_table(spark, path, schemas.PAPER_CORRIDOR).collect())
    assert read() == ["2", "3"] and os.path.isdir(f"{path}.next")
    store.append(frame("4"), path)
    assert read() == ["2", "3", "4"] and sorted(os.listdir(tmp_path)) == ["t"]
    store.replace(frame("5"), path)
    assert read() == ["5"]
