"""Explicit schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_s, _i, _l, _t, _b = StringType(), IntegerType(), LongType(), TimestampType(), BooleanType()


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


PAPERS = _struct(pmid=_s, pub_date=_s, pub_year=_i, journal=_s, title=_s, abstract=_s, raw=_s, fetched_at=_t)
PAPER_CORRIDOR = _struct(pmid=_s, corridor=_s)
SYNONYMS = _struct(descriptor=_s, forms=ArrayType(_s), fetched_at=_t)
RESPONSES = _struct(cache_key=_s, endpoint=_s, params=_s, response=_s, fetched_at=_t)
RUNS = _struct(run_id=_s, started_at=_t, code_version=_s, config=_s, split=_s, max_date=_s)
TRIPLE = _struct(subject=_s, predicate=_s, object=_s, evidence=_s)
USAGE = _struct(prompt_tokens=_l, output_tokens=_l, total_tokens=_l)
PAYLOAD = _struct(prompt_version=_s, model=_s, relations=ArrayType(TRIPLE), usage=USAGE, parse_ok=_b)
EXTRACTIONS = _struct(pmid=_s, model=_s, prompt_hash=_s, payload=_s, created_at=_t)
RELATIONS = _struct(pmid=_s, relations=ArrayType(TRIPLE))
HYPOTHESES = _struct(term=_s, score=DoubleType(), rank=_i, split=_s, method=_s)

#: An article as delivered: repeated elements are arrays, anything unknown is left out.
_DATE = _struct(Year=_s, Month=_s, Day=_s, MedlineDate=_s)
ARTICLE = _struct(
    MedlineCitation=_struct(
        PMID=_s,
        DateCompleted=_struct(Year=_s),
        DateRevised=_struct(Year=_s),
        MeshHeadingList=ArrayType(_struct(DescriptorName=_s)),
        Article=_struct(
            ArticleTitle=_s,
            Abstract=_struct(AbstractText=_s),  # text, or a JSON list of texts
            Journal=_struct(Title=_s, JournalIssue=_struct(PubDate=_DATE)),
        ),
    )
)
