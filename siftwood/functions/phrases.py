"""Phrases of a dictionary found in normalised texts, in one pass over a text whatever the number of phrases.

A text's words (runs of a-z and 0-9) are looked up by hash among the phrases' keys, each its longest word. Only the few phrases whose key
the text has are looked at: those of one word are found by that, others are searched for with their borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import quoted, term_pattern

WORD = "[a-z0-9]+"
BETWEEN = "[^a-z0-9]+"
NONE = "cast(array() as array<string>)"


def key_of(term: str) -> str | None:
    """The longest word of a phrase, the first of equally long ones; none without a word."""
    return max(re.findall(WORD, term), key=len, default=None)


def _literal(value: str | None) -> str:
    return "cast(null as string)" if value is None else quoted(value)


def found_terms(name: str, terms: Iterable[str]) -> Column:
    """The distinct terms that a named column of normalised text holds as whole terms, in the order given. One parsed expression."""
    each = list(dict.fromkeys(terms))
    if not each:
        return F.expr(NONE)
    keys = [key_of(t) for t in each]
    # a term of one word needs no search; others keep the pattern of their borders
    rows = ", ".join(f"struct({quoted(t)} as term, {_literal(k)} as key, {_literal(None if t == k else term_pattern(t))} as pattern)" for t, k in zip(each, keys, strict=True))
    known = ", ".join(quoted(k) for k in dict.fromkeys(k for k in keys if k)) or "cast(null as string)"
    present = f"array_intersect(split(`{name}`, '{BETWEEN}'), array({known}))"
    holds = f"(r.key IS NULL OR array_contains(p, r.key)) AND (r.pattern IS NULL OR (contains(`{name}`, r.term) AND `{name}` RLIKE r.pattern))"
    return F.expr(f"CASE WHEN `{name}` IS NULL THEN {NONE} ELSE transform(array({present}), p -> transform(filter(array({rows}), r -> {holds}), r -> r.term))[0] END")


def among(found: Column | str, terms: Iterable[str]) -> Column:
    """Those terms of a list, in its order, that were found."""
    listed = ", ".join(quoted(t) for t in terms)
    name = found if isinstance(found, str) else None
    if name is not None:
        return F.expr(f"filter(array({listed}), t -> array_contains(`{name}`, t))" if listed else NONE)
    return F.filter(F.expr(f"array({listed})" if listed else NONE), lambda t: F.array_contains(found, t))


def points_of(found: str, rules) -> Column:
    """Sum of the points of all (term, points, ...) rules whose term was found."""
    if not rules:
        return F.lit(0)
    rows = ", ".join(f"struct({quoted(term)} as term, {int(points)} as points)" for term, points, *_ in rules)
    return F.expr(f"aggregate(filter(array({rows}), r -> array_contains(`{found}`, r.term)), 0, (a, r) -> a + r.points)")


def reasons_of(found: str, rules) -> Column:
    """Reasons of the (term, points, reason) rules whose term was found, in order."""
    if not rules:
        return F.expr(NONE)
    rows = ", ".join(f"struct({quoted(term)} as term, {quoted(reason)} as reason)" for term, _, reason in rules)
    return F.expr(f"transform(filter(array({rows}), r -> array_contains(`{found}`, r.term)), r -> r.reason)")


def rule_hits(texts: DataFrame, id_col: str, text_col: str, rules: DataFrame, term_col: str = "term") -> DataFrame:
    """(id_col, rules' columns): each rule with each row whose normalised text holds the rule's term, for a table of rules of any size.

    Words and rules meet in a join on the key; texts travel once, and only to rules of more than one word that have a candidate. id_col must be unique; rows without
    a text, and rules without a term or without a word of a-z and 0-9 in it, have no hits. Rules that are there twice hit twice.
    """
    key = F.transform(F.filter(F.split(F.col(term_col), BETWEEN), lambda w: w != ""), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w")))
    keyed = rules.withColumn("__key", F.array_max(key)["w"]).where("__key is not null")
    words = texts.select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(F.split(F.col(text_col), BETWEEN))).alias("__key")).where("__key <> ''")
    candidates = words.join(keyed, "__key")
    plain = candidates.where(F.col(term_col) == F.col("__key")).select("__id", *rules.columns)
    longer = candidates.where(F.col(term_col) != F.col("__key")).select("__id", *rules.columns)
    escaped = F.regexp_replace(F.col(term_col), r"([^\p{L}\p{N}_\s])", r"\\$1")
    pattern = F.concat(F.lit("(?<![a-z0-9])"), escaped, F.lit("(?![a-z0-9])"))
    said = texts.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    searched = longer.join(said, "__id").where(F.contains(F.col("__text"), F.col(term_col)) & F.regexp_like("__text", pattern))
    return plain.unionByName(searched.select("__id", *rules.columns)).withColumnRenamed("__id", id_col)
