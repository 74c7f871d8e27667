import json
import os

import pytest
from pyspark import cloudpickle

from lumenbridge import cli, config, schemas
from lumenbridge.operators import relations, store
from lumenbridge.sources import clients

cloudpickle.register_pickle_by_value(clients)


def test_backoff_only_on_passing_errors():
    waits, failing = [], [clients.ServiceError("x", 503), clients.ServiceError("x"), clients.ServiceError("x", 429)]

    def flaky():
        if failing:
            raise failing.pop()
        return 7

    assert clients.call(flaky, sleep=waits.append) == 7 and waits == [1, 2, 4]
    for error in (clients.ServiceError("no", 400), clients.QuotaExhausted("spent", 429)):
        def fail(e=error):
            raise e

        with pytest.raises(clients.ServiceError):
            clients.call(fail, sleep=lambda s: pytest.fail("waited"))


def test_throttle_spaces_calls():
    now, slept = [0.0], []
    t = clients.Throttle(2, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        t.wait()
    assert slept == [0.5, 1.0]


def test_search_source(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in ({"query": "q", "ids": [3, 1, 2]}, {"query": "q", "min_year": 2000, "ids": [9]})))
    clients.register(spark)
    got = spark.read.format("paper_search").options(responses=str(path), query="q", retmax="2").load().orderBy("position").collect()
    assert [tuple(r) for r in got] == [("3", 0, 3), ("1", 1, 3)]


def test_extraction_resumes_within_its_budget(spark, tmp_path):
    papers = spark.createDataFrame([(str(i), "T", f"abstract {i}") for i in range(6)], "pmid string, title string, abstract string")
    path = str(tmp_path / "extractions")

    def ask(prompt):
        if "abstract 1" in prompt:
            raise clients.ServiceError("bad", 400)
        if "abstract 4" in prompt:
            raise clients.QuotaExhausted("spent")
        return '{"relations": []}'

    first = clients.extract(spark, papers, path, "m", ask, budget=3, per_second=1e6)
    assert sorted(r.pmid for r in first.collect()) == ["0", "2", "3"]  # the failed paper spends nothing
    assert [r.pmid for r in relations.pending(papers, store.open_table(spark, path, schemas.EXTRACTIONS), "m").collect()] == ["1", "4", "5"]
    assert clients.extract(spark, papers, path, "m", ask, budget=9, per_second=1e6).count() == 0  # the quota is spent
    third = clients.extract(spark, papers, path, "m", lambda prompt: "{}", budget=9, per_second=1e6)
    assert sorted(r.pmid for r in third.collect()) == ["1", "4", "5"]


def test_failing_papers_neither_spend_the_budget_nor_stop_later_ones(spark, tmp_path):
    papers = spark.createDataFrame([(f"{i:02}", "T", f"abstract {i}") for i in range(20)], "pmid string, title string, abstract string")
    path = str(tmp_path / "extractions")

    def ask(prompt):
        if int(prompt.rsplit(" ", 1)[1]) < 10:
            raise clients.ServiceError("bad", 400)
        return '{"relations": []}'

    got = clients.extract(spark, papers, path, "m", ask, budget=4, per_second=1e6, batch=3)
    assert sorted(r.pmid for r in got.collect()) == ["10", "11", "12", "13"]
    assert sorted(r.pmid for r in clients.extract(spark, papers, path, "m", ask, per_second=1e6, batch=7).collect()) == [f"{i}" for i in range(14, 20)]


def test_answers_so_far_survive_a_crash(spark, tmp_path):
    papers = spark.createDataFrame([(f"{i:02}", "T", f"abstract {i}") for i in range(9)], "pmid string, title string, abstract string")
    path = str(tmp_path / "extractions")

    def ask(prompt):
        if "abstract 7" in prompt:
            raise RuntimeError("crash")
        return "{}"

    with pytest.raises(Exception):
        clients.extract(spark, papers, path, "m", ask, per_second=1e6, batch=3)
    assert store.open_table(spark, path, schemas.EXTRACTIONS).count() == 6


ARTICLE = {"MedlineCitation": {"PMID": "1", "Article": {"ArticleTitle": "T", "Abstract": {"AbstractText": ["a", "b"]}, "Journal": {"Title": "J", "JournalIssue": {"PubDate": {"Year": "2001"}}}}}}


def fake(calls):
    def transport(endpoint, params):
        calls.append((endpoint, params))
        if endpoint == "search":
            year = int(params["min_year"])
            return {"ids": [f"{year}{k}" for k in range(3)], "total": 5 if year == 2001 else 3}
        if endpoint == "fetch":
            out = []
            for pmid in params["ids"].split(","):
                a = json.loads(json.dumps(ARTICLE))
                a["MedlineCitation"]["PMID"] = pmid
                out.append(a)
            return {"articles": [*out, {"none": 1}]}
        if endpoint == "term_search":
            return {"ids": [] if params["term"] == "Unknown" else [7]}
        return {"terms": ["aspirin", " Acid ", "ASPIRIN"]}
    return transport


def test_ingest_asks_once_and_repeats_offline(spark, tmp_path):
    calls, root = [], str(tmp_path / "store")
    service = clients.Service(spark, f"{root}/responses", fake(calls), 1e6)
    corridors = {"A": "qa", "C": "qc"}
    done = clients.ingest(service, root, corridors, 3, (2000, 2001))
    assert (done["wanted"], done["saved"], done["total_hits"], done["truncated"]) == (6, 6, 16, True)
    papers = store.open_table(spark, f"{root}/papers", schemas.PAPERS)
    assert papers.count() == 6 and papers.first().abstract == "a\nb"
    assert store.open_table(spark, f"{root}/corridor", schemas.PAPER_CORRIDOR).count() == 12
    n = len(calls)
    again = clients.ingest(clients.Service(spark, f"{root}/responses"), root, corridors, 3, (2000, 2001))  # no transport
    assert again["saved"] == 0 and len(calls) == n
    with pytest.raises(clients.ServiceError):
        clients.ingest(clients.Service(spark, f"{root}/responses"), root, corridors, 3, (2000, 2002))


def test_batches_of_records(spark, tmp_path):
    calls = []
    service = clients.Service(spark, str(tmp_path / "responses"), fake(calls), 1e6)
    assert clients.fetch(service, [str(i) for i in range(7)] * 2, str(tmp_path / "papers"), batch=3) == 7
    assert [len(p["ids"].split(",")) for e, p in calls if e == "fetch"] == [3, 3, 1]


def test_synonyms_are_kept(spark, tmp_path):
    calls, path = [], str(tmp_path / "synonyms")
    service = clients.Service(spark, str(tmp_path / "responses"), fake(calls), 1e6)
    got = {r.descriptor: r.forms for r in clients.synonyms(service, ["Aspirin", "Unknown"], path).collect()}
    assert got == {"Aspirin": ["Aspirin", "Acid"], "Unknown": ["Unknown"]}
    n = len(calls)
    assert clients.synonyms(service, ["Aspirin"], path).count() == 1 and len(calls) == n


def test_secrets_and_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("A=1\nexport KEY = 'x y'\nEMPTY=\n")
    monkeypatch.setenv("FROM_ENV", "e")
    at = str(tmp_path / ".env")
    assert [config.secret(k, at) for k in ("A", "KEY", "EMPTY", "NONE", "FROM_ENV")] == ["1", "x y", None, None, "e"]
    path = tmp_path / "study.json"
    path.write_text(json.dumps({"splits": [{"name": "dev", "cutoff": "2010-12-31", "first": "2011-01-01", "last": "2015-12-31"}], "anchors_a": ["X"], "known": [{"label": "k", "hint": "a;b"}], "ranking": {"top_k": [5]}}))
    study = config.load_study(str(path))
    assert study.splits[0].cutoff == 2010 and study.anchors == ("X",) and study.ranking.top_k == (5,) and study.known[0].hint == "a;b"
    path.write_text('{"spilts": []}')
    with pytest.raises(ValueError):
        config.load_study(str(path))


def test_command_line_of_the_store(spark, tmp_path, monkeypatch, capsys):
    settings, root = tmp_path / "c.json", str(tmp_path / "store")
    settings.write_text(json.dumps({"corridors": {"A": "qa", "C": "qc"}, "cap": 3, "years": [2000, 2001]}))
    monkeypatch.setattr(cli, "transport", lambda name: fake([]) if name == "web" else (lambda prompt: '{"relations": []}') if name else None)
    ingest = ["ingest", "--root", root, "--config", str(settings)]
    assert cli.main(ingest) == 2  # nothing stored, nothing to ask
    assert cli.main([*ingest, "--transport", "web", "--secret", "NO_SUCH_SECRET"]) == 2
    assert cli.main(["extract", "--root", root, "--transport", "llm"]) == 2  # no papers
    assert cli.main([*ingest, "--transport", "web"]) == 0
    assert cli.main(["extract", "--root", root]) == 2
    assert cli.main(["extract", "--root", root, "--transport", "llm", "--limit", "2", "--per-second", "1e6"]) == 0
    assert "2 fresh extractions" in capsys.readouterr().out
    assert cli.main(["extract", "--root", root, "--transport", "llm", "--max-year", "1990"]) == 2
    assert cli.main(["open", "--data", str(tmp_path), "--root", str(tmp_path / "empty")]) == 2
    assert cli.main(["closed", "--data", str(tmp_path / "absent")]) == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_command_line(spark, capsys):
    assert cli.main(["closed", "--data", "/root/testdata/sf0.001"]) in (0, 1)
    assert "known terms" in capsys.readouterr().out
    for task in (["slices", "--relations", "grounded"], ["open"], ["coverage"], ["cost"], ["report"]):
        assert cli.main([*task, "--data", "/root/testdata/sf0.001"]) in (0, 1)
