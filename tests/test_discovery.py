import pytest

from lumenbridge.config import KnownTerm, Ranking, Split
from lumenbridge.operators import discovery, incidence, slicing

RANK = Ranking()


def stats(spark, rows):
    return spark.createDataFrame([(t, a, c, n, None, None) for t, a, c, n in rows], "term string, a_df long, c_df long, total_df long, a_first_year int, c_first_year int")


def total(spark, n=1000):
    return spark.createDataFrame([(n,)], "total_papers long")


@pytest.mark.parametrize("rows, want", [
    ([("Good", 10, 10, 20), ("OnlyA", 10, 0, 10), ("OnlyC", 0, 10, 10)], ["Good"]), ([("Rare", 2, 2, 4), ("Keep", 5, 5, 10)], ["Keep"]),
    ([("Generic", 150, 150, 300), ("Specific", 20, 20, 40)], ["Specific"]), ([("Skewed", 39, 1, 40), ("Bal", 20, 20, 40)], ["Bal", "Skewed"]),
])
def test_closed(spark, rows, want):
    got = discovery.closed_discovery(stats(spark, rows), total(spark), RANK).orderBy("rank").collect()
    assert [r.term for r in got] == want


def test_gate(spark):
    cand = discovery.closed_discovery(stats(spark, [("IL-6", 20, 20, 40), ("Butyrates", 8, 8, 16)]), total(spark), RANK)
    gate = discovery.known_term_gate(cand, (KnownTerm("x", "IL-6"), KnownTerm("y", "Acids; Butyrates;IL-6"), KnownTerm("z", "None")))
    assert {r.label: (r.best_descriptor, r.best_rank) for r in gate.collect()} == {"x": ("IL-6", 1), "y": ("IL-6", 1), "z": (None, None)}
    assert tuple(discovery.gate_verdict(gate, RANK).first()) == (2, 3, False)


def papers(spark, rows):
    return spark.createDataFrame(rows, "pmid string, yr int, in_a boolean, in_c boolean")


def test_graph(spark):
    p = papers(spark, [("1", 2005, True, False), ("2", 2001, True, False), ("3", 2010, False, True), ("4", 2018, False, True), ("5", None, True, True), ("6", 2000, False, False)])
    t = spark.createDataFrame([("1", "M"), ("1", "IL-6"), ("2", "M"), ("2", "IL-6"), ("3", "N"), ("3", "IL-6"), ("4", "N"), ("4", "Butyrates"), ("5", "Late"), ("6", "IL-6")], "pmid string, term string")
    inc = incidence.incidence(p, t, ("M", "N"))
    got = {r.term: tuple(r)[1:] for r in incidence.term_stats(inc).collect()}
    assert got == {"IL-6": (2, 1, 3, 2001, 2010), "Butyrates": (0, 1, 1, None, 2018), "Late": (1, 1, 1, None, None)}
    edges = {(r.side, r.term): (r.weight, r.pmids, r.years) for r in incidence.edge_evidence(inc).collect()}
    assert edges["A", "IL-6"] == (2, ["1", "2"], [2001, 2005]) and ("A", "Butyrates") not in edges


def test_grounded_graph(spark):
    p = papers(spark, [("1", 2001, True, False), ("2", 2005, True, False), ("3", 2010, False, True)])
    t = spark.createDataFrame([("1", "IL-6"), ("1", "Adult"), ("2", "IL-6"), ("2", "Adult"), ("3", "IL-6")], "pmid string, term string")
    r = spark.createDataFrame([("1", [("IL-6", "x", "y", "")]), ("3", [("z", "x", "IL-6", "")])], "pmid string, relations array<struct<subject string, predicate string, object string, evidence string>>")
    plain = {x.term: (x.a_df, x.c_df) for x in incidence.term_stats(incidence.incidence(p, t)).collect()}
    held = incidence.ground(t, r).filter("grounded")
    grounded = {x.term: (x.a_df, x.c_df) for x in incidence.term_stats(incidence.incidence(p, held)).collect()}
    assert plain == {"IL-6": (2, 1), "Adult": (2, 0)} and grounded == {"IL-6": (1, 1)}


def year_lists(spark, rows):
    """Incidence rows from (term, years on A, years on C, grounded years on A)."""
    out = []
    for term, a, c, g in rows:
        out += [(f"{term}a{i}", term, y, True, False, y in g) for i, y in enumerate(a)] + [(f"{term}c{i}", term, y, False, True, False) for i, y in enumerate(c)]
    return spark.createDataFrame(out, "pmid string, term string, yr int, in_a boolean, in_c boolean, grounded boolean")


def sizes(spark, n):
    return spark.createDataFrame([("dev", n, n)], "split string, n_a long, n_c long")


SPLIT = (Split("dev", 2010, 2011, 2015),)
LOOSE = Ranking(df_min=1, df_max_ratio=1.0, top_k=(10, 25))


def closed(spark, rows):
    return slicing.closed_slices(slicing.slice_counts(year_lists(spark, rows), SPLIT), sizes(spark, 100), LOOSE)


def test_closed_slices(spark):
    rows = closed(spark, [("X", [2005, 2009, 2012], [2010, 2013], []), ("Y", [2005], [2013], [])]).collect()
    assert [(r.term, r.a_pre, r.c_pre, r.a_post, r.c_post) for r in rows] == [("X", 2, 1, 1, 1)]


def test_hits_metrics_and_monotony(spark):
    cand = closed(spark, [("H1", [2008, 2009, 2013], [2009, 2010, 2014], []), ("H2", [2007, 2012], [2010, 2013], []), ("Miss", [2006], [2008], [])])
    from pyspark.sql import functions as F
    sweep = slicing.hit_sweep(cand, F.least("a_post", "c_post"), SPLIT, LOOSE)
    got = {r.n: (r.candidates, r.hits) for r in sweep.collect()}
    assert got == {1: (3, 2), 2: (3, 0), 3: (3, 0), 5: (3, 0)}
    star = slicing.threshold(sweep, LOOSE)
    assert star.first().n_star == 1
    m = {(r.method, r.k): (r.precision, r.recall) for r in slicing.precision_recall(slicing.labelled(slicing.ranked(slicing.scored(cand), 1), star), LOOSE).collect()}
    assert m["frequency", 10] == (0.2, 1.0) and all(m[x, 10][1] <= m[x, 25][1] for x in ("pmi", "frequency", "random", "grounded"))


def test_open_slices(spark):
    split = (Split("dev", 2015, 2016, 2025),)
    inc = year_lists(spark, [("B_open", [2010], [2020], [2010]), ("B_bridge", [2008], [2009], []), ("B_stuck", [2011], [], [])])
    cand = slicing.open_slices(slicing.slice_counts(inc, split), sizes(spark, 10), LOOSE)
    assert {r.term: (r.present, r.absent_post) for r in cand.collect()} == {"B_open": ("A", 1), "B_stuck": ("A", 0)}
    star = spark.createDataFrame([(1,)], "n_star int")
    m = slicing.precision_recall(slicing.labelled(slicing.ranked(slicing.open_scored(cand), 1), star), LOOSE).collect()
    assert {(r.method, r.k): r.precision for r in m}["grounded", 10] == 0.1


def test_no_leak_after_the_cutoff(spark):
    rows = [("X", [2005, 2009], [2010], [2005]), ("Y", [2004], [2006, 2007], [])]
    later = [(t, [*a, 2012, 2013], [*c, 2014], g) for t, a, c, g in rows]
    scores = [sorted(map(tuple, slicing.scored(closed(spark, r)).select("term", "method", "score").collect()), key=repr) for r in (rows, later)]
    assert scores[0] == scores[1]


def test_splits_must_be_whole_years():
    assert Split.from_dates("dev", "2018-12-31", "2019-01-01", "2021-12-31") == Split("dev", 2018, 2019, 2021)
    with pytest.raises(ValueError):
        Split.from_dates("dev", "2018-06-30", "2019-01-01", "2021-12-31")
