"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of whole texts are taken in numpy over Arrow batches. Small trees
are grown on a bounded sample of labelled rows (``SAMPLE`` rows in the order of
a hash of their ids; a parameter), each path of a tree becomes a conjunctive
rule, a lasso-penalised logistic regression keeps few of the rules, and the
kept rules are compiled into one Spark column expression that scores all rows.

Defined cases: null and empty texts have statistics of zero and are scored by
the same rules; without labelled rows every score is 0.5, with one label only
it is the smoothed prior; a document labelled twice counts with its smallest
label, null labels are ignored; of rows that repeat a labelled id, the one with
the smallest statistics is learned from, and each is scored; very long texts
are measured whole, as are repeated rows, which get equal scores; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import held_out

SAMPLE = 20_000
TREES, DEPTH, LEAST_LEAF, CUTS = 24, 3, 20, 24
LASSO, STEPS, SEED = 2e-3, 800, 7
#: A score of at least this is predicted as 1.
CUT = 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # others: 0
for _k, _chars in enumerate((b" \t\n\r\x0b\x0c", bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), bytes(range(48, 58)), b".,;:'-", b"!?", b"|", b"#$%&*+/<=>@[\\]^_`{}~()\""), 1):
    _CLASS[list(_chars)] = _k
STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop_marks", "loud_marks", "bars", "symbols", "other",
    "distinct_words", "repeated_words", "distinct_lines", "line_words", "upper_words", "marked_words",
)


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    n = max(1, len(text))
    by_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=by_byte, minlength=9) / n
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), (1 - by[1]) * n / w, by[3], by[4], by[5], by[6], by[7], by[8], by[0],
        len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w, len(set(lines)) / len(lines), w / len(lines),
        sum(map(bytes.isupper, words)) / w, 1 - sum(map(bytes.isalnum, words)) / w,
    ]


def _measure(batches):
    for batch in batches:
        at = batch.schema.names.index("text")
        rows = np.array([statistics(x) for x in batch.column(at).to_pylist()]).reshape(-1, len(STATS)).round(9)
        keep = [i for i in range(len(batch.schema.names)) if i != at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(rows[:, j]) for j in range(len(STATS)))], [*(batch.schema.names[i] for i in keep), *STATS])


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with the statistics in place of its column ``text``."""
    rows = rows.select(*[F.col(c).cast("binary").alias(c) if c == "text" else c for c in rows.columns])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + [f"{s} double" for s in STATS])
    return rows.mapInArrow(_measure, schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, over?, threshold), all of which must hold


def grow(x: np.ndarray, r: np.ndarray, rng: np.random.Generator) -> tuple[list[Rule], np.ndarray]:
    """The paths of a regression tree on the residuals ``r``, and its fitted values."""
    rules, fitted = [], np.zeros(len(r))

    def part(at: np.ndarray, path: Rule) -> None:
        fitted[at] = r[at].mean()
        if path:
            rules.append(path)
        if len(path) >= DEPTH or len(at) < 2 * LEAST_LEAF:
            return
        best = (1e-9, None)
        for j in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
            v = x[at, j]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")):
                over = v > cut
                n = int(over.sum())
                if min(n, len(at) - n) < LEAST_LEAF:
                    continue
                s = r[at][over].sum()
                gain = s * s / n + (r[at].sum() - s) ** 2 / (len(at) - n) - r[at].sum() ** 2 / len(at)
                if gain > best[0]:
                    best = (gain, (int(j), float(cut), over))
        if best[1]:
            j, cut, over = best[1]
            part(at[over], (*path, (j, True, cut)))
            part(at[~over], (*path, (j, False, cut)))

    part(np.arange(len(r)), ())
    return rules, fitted


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, over, cut in rule:
        out &= (x[:, j] > cut) == over
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y):
        return 0.0, []
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if y.min() == y.max():
        return float(prior), []
    rng = np.random.default_rng(SEED)
    z, rules = np.full(len(y), prior), {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-z))
        grown, _ = grow(x, residual, rng)
        for rule in grown:
            rules.setdefault(rule)
        leaves = [r for r in grown if not any(len(o) > len(r) and o[: len(r)] == r for o in grown)]
        for rule in leaves:
            at = holds(x, rule)
            if at.any():
                z[at] += 1.5 * residual[at].mean()
    names = list(rules)
    a = np.stack([holds(x, r) for r in names], axis=1).astype(float) if names else np.zeros((len(y), 0))
    w, b, v, vb, t = np.zeros(len(names)), float(prior), np.zeros(len(names)), float(prior), 1.0
    step = 4.0 / max(1.0, float(a.sum(axis=1).mean()) + 1)
    for _ in range(STEPS):  # accelerated proximal gradient
        g = 1 / (1 + np.exp(-(a @ v + vb))) - y
        nw = v - step * (a.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        nb, nt = vb - step * g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return round(float(b), 6), [(r, round(float(k), 6)) for r, k in zip(names, w) if abs(k) > 1e-6]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble's probability of label 1 as a column over the statistics."""
    z = F.lit(intercept)
    for rule, weight in rules:
        cond = F.lit(True)
        for j, over, cut in rule:
            cond &= (F.col(STATS[j]) > cut) if over else (F.col(STATS[j]) <= cut)
        z = z + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[Rule, float]]]:
    """Fit on at most ``sample`` labelled documents of the training folds. Both frames have a ``doc_id``."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # `chosen` has at most `sample` rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    one = with_statistics(rows).groupBy("doc_id").agg(F.min(F.struct("quality", *STATS)).alias("row"))  # at most `sample` rows, however often ids repeat
    found = one.select("doc_id", "row.*").toArrow().sort_by("doc_id")
    x = np.stack([found.column(s).to_numpy() for s in STATS], axis=1) if found.num_rows else np.zeros((0, len(STATS)))
    return fit(x, found.column("quality").to_numpy().astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    labels = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality"))
    intercept, rules = train(docs, labels, sample)
    score = compile_rules(intercept, rules)
    return with_statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= CUT, 1).otherwise(0)
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
