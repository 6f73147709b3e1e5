"""Pieces of DuckDB SQL that several comparison queries share."""

from __future__ import annotations

from ..functions import vocab


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values: object) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '\s+'), lambda w: w <> '')"


def plain(x: str) -> str:
    return f"list_distinct({words(x)})"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({words(x)}, lambda w: trim(w, {text(vocab.PUNCTUATION)})), lambda w: length(w) > 2 AND NOT list_contains({strings(vocab.STOP_WORDS)}, w)))"


def short_tokens(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({words(x)}, lambda w: trim(w, {text(vocab.SHORT_PUNCTUATION)})), lambda w: length(w) > 2 AND NOT list_contains({strings(vocab.SHORT_STOP_WORDS)}, w)))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared} / (len({a}) + len({b}) - {shared}) ELSE 0.0 END"


def any_word(columns: tuple[str, ...], query: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {text(w)})" for c in columns for w in dict.fromkeys(query.lower().split())) + ")"
