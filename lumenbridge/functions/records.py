"""Article records to paper columns: Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ARTICLE

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def safe_year(text: Column) -> Column:
    """The first four characters of the trimmed text if they are all digits, else null."""
    head = F.substring(F.trim(text), 1, 4)
    return F.when(head.rlike("^[0-9]+$"), head.try_cast("int"))


def month_number(text: Column) -> Column:
    """1 to 12 from digits or from the first three letters of an English name, else null."""
    name = F.trim(text)
    by_name = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(k))])
    number = F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))
    return F.when(number.isNotNull(), F.when(number.between(1, 12), number)).otherwise(F.try_element_at(by_name, F.lower(F.substring(name, 1, 3))))


def pub_date(year: Column, month: Column, day: Column, medline: Column, completed: Column, revised: Column) -> tuple[Column, Column]:
    """(pub_date, pub_year) of the date elements of a record.

    With a year: ``Y``, ``Y-MM`` or ``Y-MM-DD``, the day only after a valid
    month and if all digits. Else the free text as it stands and its first four
    characters as year. Without a year from either, the year of completion or,
    if there is none, of revision; it is the date too if there is none.
    """
    year, medline = F.nullif(F.trim(year), F.lit("")), F.nullif(medline, F.lit(""))
    m = month_number(month)
    with_month = F.concat(year, F.lit("-"), F.lpad(m.cast("string"), 2, "0"))
    d = F.trim(day)
    full = F.when(m.isNull(), year).when(d.rlike("^[0-9]+$"), F.concat(with_month, F.lit("-"), F.when(F.length(d) < 2, F.lpad(d, 2, "0")).otherwise(d))).otherwise(with_month)
    date = F.when(year.isNotNull(), full).otherwise(medline)
    own = F.when(year.isNotNull(), safe_year(year)).otherwise(safe_year(medline))
    other = safe_year(F.coalesce(completed, revised))
    return F.coalesce(date, F.when(own.isNull(), other.cast("string"))), F.coalesce(own, other)


def join_abstract(parts: Column) -> Column:
    """Parts that aren't blank, untrimmed, joined by newlines; null if nothing is left."""
    return F.nullif(F.array_join(F.filter(parts, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), "\n"), F.lit(""))


def abstract_of(text: Column) -> Column:
    """An abstract that is one text (trimmed) or a JSON list of texts (joined)."""
    parts = F.from_json(text, "array<string>")
    return F.when(text.startswith("[") & parts.isNotNull(), join_abstract(parts)).otherwise(F.nullif(F.trim(text), F.lit("")))


def descriptors(headings: Column) -> Column:
    """Distinct descriptor names that aren't empty; none where the list is missing."""
    names = F.transform(headings, lambda h: h["DescriptorName"])
    return F.coalesce(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))), F.array().cast("array<string>"))


def parse_articles(raw: DataFrame, json_col: str = "raw", keep_raw: bool = False) -> DataFrame:
    """pmid, pub_date, pub_year, journal, title, abstract, descriptors (and the record, as ``raw``) of every record with an id and an article."""
    record = F.from_json(F.col(json_col), ARTICLE)["MedlineCitation"]
    rows = raw.select(record.alias("r"), F.col(json_col).alias("raw")).filter(F.col("r.PMID").isNotNull() & F.col("r.Article").isNotNull())
    date = F.col("r.Article.Journal.JournalIssue.PubDate")
    when, year = pub_date(date["Year"], date["Month"], date["Day"], date["MedlineDate"], F.col("r.DateCompleted.Year"), F.col("r.DateRevised.Year"))
    return rows.select(
        F.col("r.PMID").alias("pmid"), when.alias("pub_date"), year.alias("pub_year"), F.col("r.Article.Journal.Title").alias("journal"),
        F.col("r.Article.ArticleTitle").alias("title"), abstract_of(F.col("r.Article.Abstract.AbstractText")).alias("abstract"), descriptors(F.col("r.MeshHeadingList")).alias("descriptors"),
        *([F.col("raw")] if keep_raw else []),
    )
