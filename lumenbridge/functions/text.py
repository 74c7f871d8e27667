"""Tokens, mention matching, extraction payloads and hashes: Column expressions only."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PAYLOAD, TRIPLE, USAGE


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; other letters split and vanish."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def stem(token: Column) -> Column:
    """Without one trailing s, if longer than three characters."""
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def matches(descriptor: Column, mention: Column) -> Column:
    """Whether a descriptor's stems (an array) stand in a mention's, as text or as a subset. Empty arrays never match."""
    inside = F.array_join(mention, " ").contains(F.array_join(descriptor, " ")) | (F.size(F.array_except(descriptor, mention)) == 0)
    return (F.size(descriptor) > 0) & (F.size(mention) > 0) & inside


def any_form_matches(forms: Column, mentions: Column) -> Column:
    """Whether any form (array of stem arrays) matches any mention (array of stem arrays)."""
    return F.exists(forms, lambda f: F.exists(mentions, lambda m: matches(f, m)))


def supported(descriptors: Column, mentions: Column) -> Column:
    """The descriptors (array of texts) that some mention (array of texts) supports, within one paper."""
    heard = F.transform(mentions, stems)
    return F.filter(descriptors, lambda d: F.exists(heard, lambda m: matches(stems(d), m)))


def mention_texts(relations: Column) -> Column:
    """Subject and object of each triple."""
    return F.flatten(F.transform(relations, lambda r: F.array(r["subject"], r["object"])))


def strip_fences(text: Column) -> Column:
    """Without a code fence: its opening line, its closing marks and a leading ``json``; a fence without newline keeps its opening."""
    t = F.trim(text)
    fenced = t.startswith("```")
    opened = F.when(t.contains("\n"), F.regexp_replace(t, r"^```[^\n]*\n", "")).otherwise(t)
    closed = F.trim(F.regexp_replace(opened, r"\s*```\s*$", ""))
    bare = F.trim(F.when(closed.startswith("json"), F.substring(closed, F.lit(5), F.length(closed))).otherwise(closed))
    return F.when(fenced, bare).otherwise(t)


def parse_relations(text: Column) -> tuple[Column, Column]:
    """(relations, parse_ok) of an extraction's answer; triples need a subject, predicate and object, evidence may be empty."""
    # in brackets, text after the object makes a list that isn't one object
    whole = F.from_json(F.concat(F.lit("["), strip_fences(text), F.lit("]")), "array<struct<relations: array<string>>>")
    found = F.when(F.size(whole) == 1, whole[0]["relations"])

    def part(r: Column, name: str) -> Column:
        return F.trim(F.coalesce(r[name], F.lit("")))

    # items are parsed one by one: one that is no object leaves the others alone
    each = F.transform(F.filter(found, lambda r: F.coalesce(F.ltrim(r).startswith("{"), F.lit(False))), lambda r: F.from_json(r, TRIPLE.simpleString()))
    clean = F.transform(each, lambda r: F.struct(*[part(r, n).alias(n) for n in ("subject", "predicate", "object", "evidence")]))
    kept = F.filter(clean, lambda r: (r["subject"] != "") & (r["predicate"] != "") & (r["object"] != ""))
    return F.coalesce(kept, F.array().cast(f"array<{TRIPLE.simpleString()}>")), found.isNotNull()


def payload_view(payload: Column) -> Column:
    """A stored payload as a struct: whole triples only, token counts 0 and ``parse_ok`` true where they are missing."""
    p = F.from_json(payload, PAYLOAD)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    whole = F.filter(p["relations"], lambda r: F.coalesce(some(r["subject"]) & some(r["predicate"]) & some(r["object"]), F.lit(False)))
    usage = F.struct(*[F.coalesce(p["usage"][n], F.lit(0)).alias(n) for n in USAGE.names])
    return F.struct(
        p["prompt_version"].alias("prompt_version"), p["model"].alias("model"), F.coalesce(whole, F.array().cast(f"array<{TRIPLE.simpleString()}>")).alias("relations"),
        usage.alias("usage"), F.coalesce(p["parse_ok"], F.lit(True)).alias("parse_ok"))


def dedupe_forms(descriptor: Column, synonyms: Column) -> Column:
    """The descriptor first, then synonyms in order, trimmed, once each whatever their case."""
    forms = F.filter(F.transform(F.concat(F.array(descriptor), F.coalesce(synonyms, F.array().cast("array<string>"))), lambda f: F.trim(f)), lambda f: f.isNotNull() & (f != ""))
    return F.filter(forms, lambda f, i: ~F.exists(F.slice(forms, F.lit(1), i), lambda g: F.lower(g) == F.lower(f)))


def split_hints(hint: Column) -> Column:
    """Hints between semicolons, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(hint, ";"), lambda h: F.trim(h)), lambda h: h != "")


PROMPT_VERSION = "v2"
INSTRUCTIONS = (
    "Read the title and the abstract below and list the relations between biomedical entities that they state. "
    "Use this text alone: add nothing that you know from elsewhere, infer nothing, and guess nothing; a relation that no sentence states is left out. "
    "Name subject and object as the text names them. Give as evidence the sentence that states the relation, word for word. "
    "Answer with JSON and nothing else: {\"relations\": [{\"subject\": \"...\", \"predicate\": \"...\", \"object\": \"...\", \"evidence\": \"...\"}]}. "
    "If the text states no relation, the list is empty."
)


def build_prompt(title: Column, abstract: Column) -> Column:
    shown = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("(none)"))
    return F.concat(F.lit(f"{INSTRUCTIONS}\n\nTitle: "), shown, F.lit("\nAbstract: "), F.trim(F.coalesce(abstract, F.lit(""))))


def prompt_hash(model: str, temperature: str, prompt: Column, version: str = PROMPT_VERSION) -> Column:
    """SHA-256 over model, version, temperature and prompt, each followed by a NUL."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(F.lit(model), nul, F.lit(version), nul, F.lit(f"t={temperature}"), nul, prompt, nul), 256)


def sorted_json(params: dict) -> str:
    """Parameters as they enter a request's key: keys in order, a blank after each comma and colon."""
    return json.dumps(params, sort_keys=True)


def request_key(endpoint: Column, params_json: Column) -> Column:
    """SHA-256 of the endpoint, a pipe and the parameters as ``sorted_json`` writes them."""
    return F.sha2(F.concat(endpoint, F.chr(F.lit(124)), params_json), 256)
