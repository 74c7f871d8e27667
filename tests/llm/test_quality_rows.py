import numpy as np

from lumenbridge.llm import quality


def test_trees_see_every_sampled_row(monkeypatch):
    rng, seen, own = np.random.default_rng(1), [], quality.grow
    x = rng.random((5000, len(quality.STATS)))
    monkeypatch.setattr(quality, "grow", lambda x, r, g: seen.append(len(x)) or own(x, r, g))
    quality.fit(x, (x[:, 0] > 0.5).astype(float))
    assert seen == [5000] * quality.TREES


def brute_score(text, intercept, rules):
    stats = np.round(quality.statistics(None if text is None else text.encode()), 9)
    z = intercept + sum(w for rule, w in rules if all((stats[j] > cut) == over for j, over, cut in rule))
    return 1 / (1 + np.exp(-z))


def test_every_row_scores_by_the_rules_and_ids_may_repeat(spark):
    rng = np.random.default_rng(4)
    say = lambda i: " ".join("w%d" % k for k in rng.integers(0, 50, 40)) if i % 4 else "| ".join("A%d" % k for k in rng.integers(0, 5, 30))
    rows = [(i, say(i)) for i in range(300)] + [(7, say(7)) for _ in range(30)] + [(900, None), (901, ""), (None, "x"), (902, "long " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS score", "4 AS quality", "5 AS log_bytes")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id long, quality int")
    intercept, rules = quality.train(docs.select("doc_id", "text"), labels, sample=240)
    assert rules
    got = sorted(((str(r.doc_id), round(r.score, 9)) for r in quality.score_quality(docs, labels, sample=240).collect()))
    assert got == sorted((str(i), round(brute_score(t, intercept, rules), 9)) for i, t in rows)
    few = labels.filter("doc_id = 7")  # the rows of one id outnumber the sample
    assert quality.score_quality(docs, few, sample=1).count() == len(rows)
