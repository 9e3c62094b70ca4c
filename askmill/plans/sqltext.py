"""SQL fragments (DuckDB) that say the same as the Column builders, for the correctness check."""

from __future__ import annotations

from askmill.functions.text import STOPWORDS


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\p{{Z}}]+'), lambda t: t <> '')"


def _no_marks(x: str) -> str:
    return rf"regexp_replace({x}, '[!-/:-@\[-`{{-~]', '', 'g')"


def official_words(x: str) -> str:
    return f"list_filter({words(_no_marks(f'lower({x})'))}, lambda t: t NOT IN ('a', 'an', 'the'))"


def joined(xs: str) -> str:
    return f"coalesce(array_to_string({xs}, ' '), '')"


def official(x: str) -> str:
    return joined(official_words(x))


def verifier_terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[A-Za-z0-9]+')), lambda t: length(t) > 1 AND t NOT IN ({stop}))"


def overlap_terms(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({words(x)}, lambda t: regexp_replace(lower(t), '[^a-z0-9]+', '', 'g')), lambda t: t <> ''))"


def joined_text(s: str) -> str:
    one = strip("coalesce(s_, '')")
    return f"coalesce(array_to_string(list_transform({s}, lambda s_: {one}), ' '), '')"


def title_text(title: str, s: str) -> str:
    return f"CASE WHEN coalesce({title}, '') <> '' THEN {title} || ' ' || {joined_text(s)} ELSE {joined_text(s)} END"


def common(a: str, b: str) -> str:
    """Multiset overlap of two lists."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda y: y = t))))), 0)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def f_measure(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
