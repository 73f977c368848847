"""SQL (DuckDB dialect) counterparts of the native expressions, for the oracles."""

from __future__ import annotations

from ranqa.functions.text import WHITESPACE_CLASS
from ranqa.operators.tagger import Lexicon, lexicon_rows


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(WHITESPACE_CLASS)}, '', 'g')"


def sql_hash32(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {q(str(seed))}, {', '.join(parts)})), 1, 8) AS BIGINT)"


def sql_hash60(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {q(str(seed))}, {', '.join(parts)})), 1, 15) AS BIGINT)"


def sql_keyword_hits(text: str, lex: Lexicon) -> str:
    pairs = ", ".join(f"{{'k': {q(kw)}, 'l': {q(label)}}}" for label, _, kw, _ in lexicon_rows(lex))
    return f"list_transform(list_filter([{pairs}], lambda p: contains({text}, p.k)), lambda p: p.l)"


def sql_tag_labels(text: str, lex: Lexicon) -> str:
    labels = ", ".join(q(label) for label, _ in lex)
    return f"list_filter([{labels}], lambda lab: list_contains({sql_keyword_hits(text, lex)}, lab))"


def sql_tag_string(text: str, lex: Lexicon) -> str:
    return f"array_to_string({sql_tag_labels(text, lex)}, ',')"


def sql_json_quote(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def sql_answer(entity: str, labels: str) -> str:
    from ranqa.operators.templates import ANSWER_ENTITY_KEY, ANSWER_LABELS_KEY
    return (f"('{{\"{ANSWER_ENTITY_KEY}\": ' || {sql_json_quote(entity)} || "
            f"', \"{ANSWER_LABELS_KEY}\": ' || {sql_json_quote(labels)} || '}}')")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_permuted(i: str, n: str, seed: int) -> str:
    """The rounds of ``operators.permute.permuted`` as a reduction over their keys."""
    from ranqa.operators.permute import PRIME, round_keys
    big = lambda v: f"CAST({v} AS BIGINT)"
    row = lambda x, k, a, c, b: f"{{'x': {x}, 'k': {k}, 'a': {a}, 'c': {c}, 'b': {b}}}"
    zero = big(0)
    keys = [row(big(i), zero, zero, zero, zero)] + [row(zero, *map(big, key)) for key in round_keys(seed)]
    mirror = f"((r.k % {n} + {n} - t.x) % {n})"
    larger = f"greatest(t.x, {mirror})"
    bit = f"(({larger} % {PRIME}) * r.a + (({larger} >> 31) % {PRIME}) * r.c + r.b) % {PRIME} % 2"
    step = row(f"CASE WHEN {bit} = 1 THEN {mirror} ELSE t.x END", zero, zero, zero, zero)
    return f"list_reduce([{', '.join(keys)}], lambda t, r: {step}).x"
