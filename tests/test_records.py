import json

import pytest
from pyspark.sql import functions as F

from lumenbridge.functions import records as R


def article(**journal_date):
    return {"MedlineCitation": {"PMID": "1", "Article": {"ArticleTitle": "T", "Journal": {"Title": "J", "JournalIssue": {"PubDate": journal_date}}}}}


def parsed(spark, *raw):
    return R.parse_articles(spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string")).collect()


@pytest.mark.parametrize("date, want", [
    ({"Year": "2013", "Month": "Mar", "Day": "5"}, ("2013-03-05", 2013)), ({"Year": "2001"}, ("2001", 2001)), ({"Year": "1999", "Month": "12"}, ("1999-12", 1999)),
    ({"MedlineDate": "2008 Winter"}, ("2008 Winter", 2008)), ({"Year": "2010", "Month": "13", "Day": "5"}, ("2010", 2010)), ({}, (None, None)),
])
def test_dates(spark, date, want):
    row = parsed(spark, article(**date))[0]
    assert (row.pub_date, row.pub_year) == want


def test_completion_year_is_the_last_resort(spark):
    a = article()
    a["MedlineCitation"]["DateRevised"] = {"Year": "1990"}
    b = article(MedlineDate="Spring")
    b["MedlineCitation"]["DateCompleted"] = {"Year": "1991"}
    assert [(r.pub_date, r.pub_year) for r in parsed(spark, a, b)] == [("1990", 1990), ("Spring", 1991)]


def test_abstracts_and_malformed(spark):
    a, b, c = article(Year="2001"), article(Year="2001"), article(Year="2001")
    a["MedlineCitation"]["Article"]["Abstract"] = {"AbstractText": ["One.", " ", "Two. "]}
    b["MedlineCitation"]["Article"]["Abstract"] = {"AbstractText": " one "}
    rows = parsed(spark, a, b, c, {"Other": 1}, {"MedlineCitation": {"PMID": "2"}})
    assert [r.abstract for r in rows] == ["One.\nTwo. ", "one", None]


def test_months(spark):
    got = spark.createDataFrame([("13",), ("Foo",), ("Jul",), ("0",), ("12",), (None,), ("january",)], "m string").select(R.month_number(F.col("m")).alias("m")).collect()
    assert [r.m for r in got] == [None, None, 7, None, 12, None, 1]


def test_descriptors_are_distinct(spark):
    a = article(Year="2001")
    a["MedlineCitation"]["MeshHeadingList"] = [{"DescriptorName": "X"}, {"DescriptorName": "X"}, {"DescriptorName": ""}, {"Other": 1}]
    assert [r.descriptors for r in parsed(spark, a, article(Year="2001"))] == [["X"], []]
