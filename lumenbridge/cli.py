"""Command line. Exit codes: 0 pass or done, 1 fail, 2 nothing to work on (no tables, extractions, secret or transport), 3 all calls failed."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, schemas
from .config import MissingExtractions
from .operators import discovery, relations, sampling, store
from .plans import catalog
from .sources import clients


def show(title: str, df: DataFrame, n: int = 25) -> None:
    print(f"== {title}")
    df.show(n, truncate=80)


def shown(spark: SparkSession, data: str, *names: str) -> None:
    for name in names:
        show(name, catalog.queries()[name](spark, data), 60)


def closed(spark: SparkSession, args) -> int:
    shown(spark, args.data, "node_counts")
    show("closed discovery", catalog.queries()["closed_discovery"](spark, args.data).filter(F.col("rank") <= args.top).orderBy("rank"), args.top)
    gate = catalog.queries()["known_term_gate"](spark, args.data)
    show("known terms", gate)
    return 0 if discovery.gate_verdict(gate, catalog.RANKING).first().passed else 1


def _judged(spark: SparkSession, args, verdict: str, *names: str) -> int:
    shown(spark, args.data, *names, verdict)
    return 0 if catalog.queries()[verdict](spark, args.data).first().passed else 1


def slices(spark: SparkSession, args) -> int:
    if args.relations == "cooccur":
        return _judged(spark, args, "verdict", "hit_sweep_closed", "precision_recall", "top_false_positives")
    need_extractions(spark, args)
    return _judged(spark, args, "grounded_verdict", "grounded_precision")


def open_(spark: SparkSession, args) -> int:
    need_extractions(spark, args)
    return _judged(spark, args, "open_verdict", "hit_sweep_open", "open_precision")


def need_extractions(spark: SparkSession, args) -> None:
    """Grounded modes need relations: those of the store at ``--root`` where one is given, else the tables' own."""
    if args.root:
        relations.TableSource(store.open_table(spark, f"{args.root}/extractions", schemas.EXTRACTIONS), args.model).require()
    elif not catalog.queries()["relations_exploded"](spark, args.data).limit(1).count():
        raise MissingExtractions("the tables have no relations")


def report(spark: SparkSession, args) -> int:
    shown(spark, args.data, "corpus_report", "papers_by_year", "corridor_overlap", "split_sizes", "sampling_report", "extraction_progress")
    return 0


def cost(spark: SparkSession, args) -> int:
    row = catalog.queries()["cost_estimate"](spark, args.data)
    show("cost_estimate", row)
    found = row.first()
    return 2 if not found.attempts else 0 if found.successes else 3


def coverage(spark: SparkSession, args) -> int:
    need_extractions(spark, args)
    shown(spark, args.data, "coverage_report", "known_coverage")
    return 0


def transport(name: str | None) -> Callable | None:
    """A callable from ``module:function``."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def ingest(spark: SparkSession, args) -> int:
    with open(args.config, encoding="utf-8") as f:
        settings = json.load(f)
    asked = transport(args.transport)
    if asked and args.secret and not config.secret(args.secret):
        print(f"{args.secret} is neither in the environment nor in .env", file=sys.stderr)
        return 2
    service = clients.Service(spark, f"{args.root}/responses", asked, settings.get("per_second", 10))
    years = tuple(settings["years"]) if settings.get("years") else None
    try:
        print(json.dumps(clients.ingest(service, args.root, settings["corridors"], settings.get("cap", 80), years, settings)))
    except clients.ServiceError as e:
        print(e, file=sys.stderr)
        return 2 if e.status == 404 and not asked else 3
    papers = inc_papers(spark, args.root)
    show("corpus", sampling.corpus_report(papers))
    show("years", sampling.papers_by_year(papers), 100)
    return 0


def inc_papers(spark: SparkSession, root: str) -> DataFrame:
    from .operators import incidence

    return incidence.flag_papers(store.open_table(spark, f"{root}/papers", schemas.PAPERS), store.open_table(spark, f"{root}/corridor", schemas.PAPER_CORRIDOR))


def extract(spark: SparkSession, args) -> int:
    """Resumable: ``--limit`` caps fresh answers, ``--max-year`` (0: none) the papers."""
    ask = transport(args.transport)
    if ask is None or args.secret and not config.secret(args.secret):
        print("extraction needs a transport and its secret", file=sys.stderr)
        return 2
    papers, corridor = store.open_table(spark, f"{args.root}/papers", schemas.PAPERS), store.open_table(spark, f"{args.root}/corridor", schemas.PAPER_CORRIDOR)
    wanted = relations.targets(papers, corridor, args.max_year or None)
    total = wanted.count()
    if not total:
        print("no paper to extract from", file=sys.stderr)
        return 2
    path = f"{args.root}/extractions"
    fresh = clients.extract(spark, papers.join(wanted, "pmid", "left_semi"), path, args.model, ask, args.limit, args.per_second)
    print(f"{fresh.count()} fresh extractions")
    known = relations.TableSource(store.open_table(spark, path, schemas.EXTRACTIONS), args.model).relations_for(wanted)
    show("progress", relations.progress(wanted, known))
    return 0


TASKS = {"closed": closed, "slices": slices, "open": open_, "report": report, "cost": cost, "coverage": coverage, "ingest": ingest, "extract": extract}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenbridge")
    parser.add_argument("task", choices=sorted(TASKS))
    parser.add_argument("--data", help="folder of the driver's tables, for reports and evaluations")
    parser.add_argument("--root", help="folder of the store, for ingest and extract")
    parser.add_argument("--config", help="JSON file: corridors, cap, years, per_second")
    parser.add_argument("--top", type=int, default=25)
    parser.add_argument("--relations", choices=("cooccur", "grounded"), default="cooccur")
    parser.add_argument("--transport", help="module:function")
    parser.add_argument("--secret", help="name of the secret that the transport needs")
    parser.add_argument("--model", default="extractor-1")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--max-year", type=int, default=0)
    parser.add_argument("--per-second", type=float, default=1.0)
    args = parser.parse_args(argv)
    needs = ("root", "config") if args.task == "ingest" else ("root",) if args.task == "extract" else ("data",)
    for name in needs:
        if not getattr(args, name):
            parser.error(f"{args.task} needs --{name}")
    if "data" in needs and "://" not in args.data and not os.path.isdir(args.data):
        print(f"{args.data} isn't there", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("lumenbridge").getOrCreate()
    try:
        return TASKS[args.task](spark, args)
    except MissingExtractions as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
