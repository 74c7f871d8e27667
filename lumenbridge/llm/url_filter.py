"""URL filter: rules first, then a logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (at most
``MAX_LABELLED`` rows, a parameter) and compiled into one Spark expression, so
scoring needs no Python, shuffle or join and takes time linear in the url.

Defined cases: a null url, or one without ``://``, has an empty host and path;
it fits no rule and its verdict is the model's for no n-grams (its bias). Of
rules that fit, the one with most characters wins, the later listed among equal
ones. Long urls are read whole. Repeated rows get equal results; an empty table gives no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import csv
import math
import os
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: (verdict, host, path); the longest fitting rule wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Small labelled table: url, and 1 for block. A fold of its urls is held out of training, to measure it.
LABELLED = "labelled_urls.csv"
LABELLED_FOLDS = 5
MAX_LABELLED = 10_000
#: Buckets of host and of path n-grams, n-gram length, hash factor.
BUCKETS, GRAM, FACTOR = 1024, 4, 131
EPOCHS, RATE, L2 = 300, 8.0, 1e-4


def labelled_urls(path: str | None = None) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Rows of a labelled table to train on, and those held out."""
    with open(path or os.path.join(os.path.dirname(__file__), LABELLED), newline="", encoding="utf-8") as f:
        rows = [(r["url"], int(r["block"])) for r in csv.DictReader(f)]
    out = [zlib.crc32(u.encode()) % LABELLED_FOLDS == 0 for u, _ in rows]
    return [r for r, o in zip(rows, out) if not o], [r for r, o in zip(rows, out) if o]


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as the Spark expressions below give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), path[:end]


def grams(text: str, offset: int) -> list[int]:
    codes, out = [ord(c) for c in text], []
    for i in range(len(codes) - GRAM + 1):
        h = 0
        for c in codes[i:i + GRAM]:
            h = h * FACTOR + c
        out.append(h % BUCKETS + offset)
    return out


def train(labelled=None, epochs: int = EPOCHS) -> tuple[float, list[float]]:
    """Bias and weights by full-batch gradient descent on mean-pooled n-grams.

    Without a table, the rows of ``labelled_urls`` to train on are taken. An empty table or one with a single label gives
    zero weights and the prior's log-odds.
    """
    if labelled is None:
        labelled = labelled_urls()[0]
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    weights, n = [0.0] * (2 * BUCKETS), len(labelled)
    pos = sum(y for _, y in labelled)
    bias = math.log((pos + 0.5) / (n - pos + 0.5))
    if pos in (0, n):
        return bias, weights
    rows = []
    for url, y in labelled:
        host, path = parts_of(url)
        ids = grams(host, 0) + grams(path, BUCKETS)
        rows.append((ids, 1.0 / max(1, len(ids)), y))
    for _ in range(epochs):
        slope, by_id = 0.0, {}
        for ids, share, y in rows:
            z = bias + share * sum(weights[i] for i in ids)
            miss = (1 / (1 + math.exp(-z)) - y) / n
            slope += miss
            for i in ids:
                by_id[i] = by_id.get(i, 0.0) + miss * share
        bias -= RATE * slope / 10
        for i, g in by_id.items():
            weights[i] -= RATE * 10 * (g + L2 * weights[i])
    return round(bias, 6), [round(w, 6) for w in weights]


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    some = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(some, pattern, 1), UPPER, LOWER), F.regexp_extract(some, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _codes(text: Column) -> Column:
    """Code points of a text."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))


def _sum_of(codes: Column, weights: list[float]) -> tuple[Column, Column]:
    """Sum of the weights of the n-grams of a text's code points, and their number: linear in the text, as places of an array are looked up."""
    count = F.greatest(F.size(codes) - (GRAM - 1), F.lit(0))
    table_ = F.lit(weights)

    def one(i: Column) -> Column:
        h = F.lit(0).cast("long")
        for k in range(GRAM):
            h = h * FACTOR + F.get(codes, i + k)
        return F.get(table_, (h % BUCKETS).cast("int"))

    total = F.aggregate(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + one(i))
    return total, count


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=None) -> DataFrame:
    """id, host, path, rule, verdict and the model's ``block_score`` (0 to 1) of every row."""
    bias, weights = train(labelled)
    host, path = url_parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", _codes(F.col("host")).alias("host_codes"), _codes(F.col("path")).alias("path_codes"))
    a, n = _sum_of(F.col("host_codes"), weights[:BUCKETS])
    b, m = _sum_of(F.col("path_codes"), weights[BUCKETS:])
    z = F.lit(bias) + (a + b) / F.greatest(n + m, F.lit(1))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), z.alias("z"))
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("z") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round(1 / (1 + F.exp(-F.col("z"))), 6).alias("block_score"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op6_sql() -> str:
    """The same model, its weights written out as lists."""
    bias, weights = train()

    def total(field: str, w: list[float]) -> str:
        h = "0"
        for k in range(GRAM):
            h = f"({h} * {FACTOR} + unicode(substr({field}, i + {k}, 1)))"
        return f"coalesce(list_sum(list_transform(range(1, greatest(length({field}) - {GRAM - 1}, 0) + 1), lambda i: ({list(w)}::DOUBLE[])[({h} % {BUCKETS}) + 1])), 0)"

    fits = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cond = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in fits]
    rule = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in cond)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cond)
    return rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), s AS (
  SELECT *, {bias} + ({total('host', weights[:BUCKETS])} + {total('path', weights[BUCKETS:])})
         / greatest(greatest(length(host) - {GRAM - 1}, 0) + greatest(length(path) - {GRAM - 1}, 0), 1) AS z
  FROM p
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END, CASE WHEN z > 0 THEN 'block' ELSE 'allow' END) AS verdict,
       round(1 / (1 + exp(-z)), 6) AS block_score
FROM s
"""
