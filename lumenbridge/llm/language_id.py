"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) and of documents by language (the prior) come from
every labelled row outside the held-out fold and are summed by Spark. The
matrix of log-probabilities has a fixed number of buckets; it is broadcast in
blocks of at most ``BLOCK_LANGS`` languages, which bounds each broadcast. With
more languages the blocks take their turns, each over the table that the one
before wrote, and carry the best language and the sum of likelihoods along.
Texts are scored whole, in numpy, over Arrow batches: n-gram hashes index the
matrix and sums are taken per document.

``score`` is the posterior of the predicted language among those learned.

Defined cases: null texts and texts without a letter get ``und`` and score 0;
so does every row when nothing can be learned (no labelled row, empty table).
Ties go to the language that sorts first. Long texts are scored in pieces;
each n-gram counts once, in the piece where it starts. Repeated rows get equal
results; rows with a null id are scored, and learned from (their id hashes as
an empty text). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, table

BITS, ORDERS = 15, (1, 2, 3)
#: Languages to a broadcast matrix.
BLOCK_LANGS = 256
#: Additive smoothing of counts.
ALPHA = 0.5
#: Characters that are handled at once.
PIECE = 400_000
FOLDS = 5
LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col, folds: int = FOLDS):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position."""
    h = codes[: len(codes) - order + 1].astype(np.uint32)
    for k in range(1, order):
        h = h * np.uint32(0x9E3779B1) + codes[k: len(codes) - order + 1 + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * order)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of several texts in a row, the row number of each, and whether n-grams that start there belong to this piece.

    A space stands before and after a text. A piece of a long text ends with the next one's first code points, as n-grams reach into them.
    """
    held, size = [], 0

    def joined():
        return tuple(np.concatenate(x) for x in zip(*held))

    for row, text in enumerate(texts):
        if not text:
            continue
        all_ = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        for i in range(0, len(all_), PIECE):
            part = all_[i: i + PIECE + max(ORDERS) - 1]
            held.append((part, np.full(len(part), row, dtype=np.int32), np.arange(len(part)) < PIECE))
            size += len(part)
            if size >= PIECE:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def n_grams(codes: np.ndarray, rows: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets, and the row of each; n-grams across two texts, and those of the next piece, are left out."""
    for order in ORDERS:
        if len(codes) < order:
            continue
        at = buckets(codes, order)
        # two pieces of one text never stand side by side: the first would have been enough for a batch
        same = own[: len(at)] & (rows[: len(at)] == rows[order - 1:])
        yield at[same], rows[: len(at)][same]


def _count(batches):
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs], dtype=np.int64)
        for piece in pieces(texts):
            for at, row in n_grams(*piece):
                both = np.bincount(number[row] << BITS | at, minlength=len(names) << BITS)
                for name, part in zip(names, both.reshape(len(names), -1)):
                    if name in seen:
                        seen[name] += part
                    else:
                        seen[name] = part.astype(np.int64)
    for name in sorted(seen):
        at = np.flatnonzero(seen[name])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[name][at], pa.int64())], ["lang", "bucket", "n"])


class Learned(NamedTuple):
    """Languages in order, their log-priors and a (language, bucket) matrix of log-probabilities."""

    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def train(rows: DataFrame) -> Iterator[tuple[Learned, bool]]:
    """Models of the languages of ``rows`` (lang, text), in blocks of ``BLOCK_LANGS``, in order, and whether more follow."""
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    docs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    last, total = None, None
    while True:
        rest = docs if last is None else docs.filter(F.col("lang") > last)
        found = rest.orderBy("lang").limit(BLOCK_LANGS + 1).collect()
        langs = [r["lang"] for r in found[:BLOCK_LANGS]]
        more = len(found) > BLOCK_LANGS
        if total is None:
            total = docs.agg(F.sum("docs")).first()[0] if more else sum(r["docs"] for r in found)
            if more:
                counts = materialise(counts, "language-counts")
        if not langs:
            return
        own = counts.filter(F.col("lang").isin(langs)) if more or last is not None else counts
        table_, number = np.zeros((len(langs), 1 << BITS)), {x: i for i, x in enumerate(langs)}
        cells = own.toArrow()  # at most BLOCK_LANGS * 2**BITS rows
        table_[[number[x] for x in cells.column("lang").to_pylist()], cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
        table_ += ALPHA
        prior = np.log([r["docs"] / total for r in found[:BLOCK_LANGS]])
        yield Learned(langs, prior, np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)), more
        if not more:
            return
        last = langs[-1]


#: What is known of a text after some languages: the best one, its log-probability with and without the prior, the sum of all
#: probabilities over its own, the mean log-probability of the n-grams it was learned from; n-grams, and whether it has a letter.
STATE = "best string, top double, fit double, total double, usual double, grams double, letters boolean"
_STATE = [c.split()[0] for c in STATE.split(", ")]


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def _judge(shared, text: str, keep_text: bool):
    """Adds a block of languages to each row's state."""

    def run(batches):
        learned = shared.value
        flat = learned.matrix
        usual = (np.exp(flat.astype(float)) * flat).sum(axis=1)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            old = {c: batch.column(c).fill_null(z).to_numpy(zero_copy_only=False) for c, z in (("top", -np.inf), ("fit", 0.0), ("total", 0.0), ("usual", 0.0))}
            logs, grams = np.zeros((len(texts), len(learned.langs))), np.zeros(len(texts))
            for piece in pieces(texts):
                for at, row in n_grams(*piece):
                    grams += np.bincount(row, minlength=len(texts))
                    for k in range(len(learned.langs)):
                        logs[:, k] += np.bincount(row, weights=flat[k][at], minlength=len(texts))
            both, row = logs + learned.prior, np.arange(len(texts))
            at = both.argmax(axis=1)
            better = both[row, at] > old["top"]
            top = np.where(better, both[row, at], old["top"])
            new = {
                "best": pa.array([learned.langs[k] if b else o for k, b, o in zip(at.tolist(), better.tolist(), batch.column("best").to_pylist())], pa.string()),
                "top": pa.array(top), "fit": pa.array(np.where(better, logs[row, at], old["fit"])),
                "total": pa.array(old["total"] * np.exp(old["top"] - top) + np.exp(both - top[:, None]).sum(axis=1)),
                "usual": pa.array(np.where(better, usual[at], old["usual"])), "grams": pa.array(grams), "letters": pa.array(map(has_letter, texts), pa.bool_()),
            }
            kept = [c for c in batch.schema.names if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in kept], kept)

    return run


def judged(rows: DataFrame, learn: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``rows`` (none of whose columns is named as the state's) and the state after all languages of ``learn`` (lang, text)."""
    out = rows.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE.split(", ")])
    started, whole = False, out.schema
    for learned, more in train(learn):
        if started:
            out = materialise(out, "language-state")
        started, keep = True, keep_text or more
        out = out.mapInArrow(_judge(rows.sparkSession.sparkContext.broadcast(learned), text, keep), whole if keep else StructType([f for f in whole if f.name != text]))
    return out


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    learn = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang"), held_out(docs[id_col]).alias("held_out"))
    return learn.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def verdicts() -> tuple[Column, Column]:
    """The language, ``und`` where there is none, and its posterior, from the state."""
    known = F.col("best").isNotNull() & F.coalesce("letters", F.lit(False))
    return F.when(known, F.col("best")).otherwise("und"), F.when(known, 1 / F.col("total")).otherwise(0.0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    lang, score = verdicts()
    return judged(rows, _training(docs, id_col, text_col, lang_col)).select("doc_id", "held_out", lang.alias("lang_pred"), score.alias("score"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


#: A text whose best language is less likely than this is rejected, as are those without letters.
LEAST_SCORE = 0.5
#: The posterior compares the learned languages only, and is near 1 for any text. So a text is rejected too if its n-grams' mean
#: log-probability in the predicted language falls short of that of the training texts' n-grams by over MARGIN + SHORT / sqrt(n-grams).
MARGIN, SHORT = 2.0, 5.0


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows, columns unchanged, whose language is identified; ``lang`` keeps its given value."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    lang, score = verdicts()
    n = F.greatest(F.col("grams"), F.lit(1.0))
    fits = F.col("usual") - F.col("fit") / n <= F.lit(MARGIN) + F.lit(SHORT) / F.sqrt(n)
    found = judged(docs.toDF(*names), _training(docs, "doc_id", "text", "lang"), names[docs.columns.index("text")], keep_text=True)
    return found.filter((lang != "und") & (score >= LEAST_SCORE) & fits).select(*names).toDF(*docs.columns)
