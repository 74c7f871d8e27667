"""The corpus pipeline: from ``documents`` to token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; what it returns is written as Parquet to the shared folder and read again
as the next stage's ``docs``. All but the last return the columns of
``documents``.

1. ``language_id``: documents without letters, whose best language has a
   posterior under one half, or whose n-grams are far less likely in it than
   those of its training texts (junk, languages not learned), go.
2. ``simhash``: of each component of near copies the smallest doc_id stays.
3. ``decontaminate``: documents that hold a window of a benchmark item go.
4. ``mixing``: documents are replicated to the sources' target weights (a
   document drawn zero times goes) and shuffled globally.
5. ``token_output``: token files are written in the shuffled order; returned
   are the digests read back from them (doc_id, start, n_tokens, ids_crc32).

Defined cases: null and empty texts, and those of white space or marks only, go
in stage 1; a null id is treated as each operator states; of rows that repeat
an id and a text one stays after stage 2, and stage 4 may copy it; very long
texts pass whole; an empty table gives no rows, and empty files; columns beyond
those of ``documents``, whatever their names, are kept up to the last stage.
What a stage has written is deleted once the next one's result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenbridge.llm import decontaminate, language_id, mixing, simhash, token_output
from lumenbridge.llm.common import discard, materialise, table


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    by = dict(zip(docs.columns, names))
    return mixing.mix(docs.toDF(*names), id_col=by["doc_id"], source_col=by["source"], text_col=by["text"]).select(*names).toDF(*docs.columns)


def stage_token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_output(docs, keep_order=True)


STAGES = [
    ("language_id", stage_language_id),
    ("simhash", stage_simhash),
    ("decontaminate", stage_decontaminate),
    ("mixing", stage_mixing),
    ("token_output", stage_token_output),
]

#: SQL can't express the language model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
