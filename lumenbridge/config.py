"""Settings of a study: corridors, splits, ranking, known terms. Values become literals of the plans."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Split:
    """Papers up to ``cutoff`` (a whole year) are known; those from ``first`` to ``last`` are to be predicted."""

    name: str
    cutoff: int
    first: int
    last: int

    @classmethod
    def from_dates(cls, name: str, cutoff: str, first: str, last: str) -> Split:
        """Windows are whole years: ``cutoff`` and ``last`` must end a year and ``first`` start one."""
        for date, day in ((cutoff, "-12-31"), (first, "-01-01"), (last, "-12-31")):
            if len(date) > 4 and not date.endswith(day):
                raise ValueError(f"{date} isn't aligned to a year")
        return cls(name, int(cutoff[:4]), int(first[:4]), int(last[:4]))


@dataclass(frozen=True)
class KnownTerm:
    label: str
    hint: str  # descriptors, separated by semicolons


@dataclass(frozen=True)
class Ranking:
    df_min: int = 5
    df_max_ratio: float = 0.25
    top_k: tuple[int, ...] = (10, 25, 50)
    seed: int = 42
    #: Hit thresholds that are tried on DEV, and the rule for taking one.
    sweep: tuple[int, ...] = (1, 2, 3, 5)
    least_hits: int = 10
    most_rate: float = 0.5
    #: Known terms that must be found for the gate to pass.
    gate_least: int = 5


@dataclass(frozen=True)
class Prices:
    """Cost model of an extraction client."""

    input_per_million: float = 0.10
    output_per_million: float = 0.40
    requests_per_day: int = 500
    requests_per_minute: int = 15


@dataclass(frozen=True)
class Study:
    splits: tuple[Split, ...]
    anchors_a: tuple[str, ...] = ()
    anchors_c: tuple[str, ...] = ()
    ranking: Ranking = field(default_factory=Ranking)
    known: tuple[KnownTerm, ...] = ()
    model: str = "extractor-1"
    prices: Prices = field(default_factory=Prices)

    @property
    def anchors(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.anchors_a, *self.anchors_c)))


def load_study(path: str) -> Study:
    """A study from a JSON file whose keys are the fields' names; splits are given by dates, known terms by label and hint."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    unknown = set(given) - {f.name for f in fields(Study)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    lists = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    return Study(**lists(given) | {
        "splits": tuple(Split.from_dates(s["name"], s["cutoff"], s["first"], s["last"]) for s in given.get("splits", [])),
        "known": tuple(KnownTerm(**k) for k in given.get("known", [])),
        "ranking": Ranking(**lists(given.get("ranking", {}))), "prices": Prices(**given.get("prices", {})),
    })


def secret(name: str, path: str = ".env") -> str | None:
    """A secret from the environment, else from a file of NAME=value lines; never part of a plan or a log."""
    if os.environ.get(name):
        return os.environ[name]
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, found, value = line.strip().partition("=")
                if found and key.removeprefix("export ").strip() == name:
                    return value.strip().strip("\"'") or None
    return None


class MissingExtractions(RuntimeError):
    """A grounded evaluation was asked for, and the model has no extractions."""
